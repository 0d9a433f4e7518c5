"""Annotating motifs from a library: embeddings, masked variants, clustered hits, structure scores, analogs, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed_word, natural_number
from ..plans.compiler import run
from .ordered import numbered
from .screening import clustered_hits, optimised, selected_hits
from .shared import settle
from .similarity import containment, cosine_pairs, cosine_top, unique_hits, unit
from .vectors import weighted_means

PROTON = 1.007276470  # fixed value: mass of a proton


def masked_spectra(motifs: DataFrame, masks: tuple[float, float] = (-1.0, -1.0)) -> DataFrame:
    """(motif, variant, frags, losses): each variant puts the mask in place of one feature, first in its list and with that feature's intensity.

    motifs (motif, kind, peak_idx, mz, i); lists hold (mz, i). Variants count fragments first, then losses; a motif without one kind
    has variants of the other.
    """
    listed = lambda kind: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("peak_idx", "kind", "mz", "i")), lambda x: x["kind"] == kind)), lambda x: F.struct(x["mz"].alias("mz"), x["i"].alias("i")))
    whole = motifs.groupBy("motif").agg(listed("frag").alias("frags"), listed("loss").alias("losses"))

    def without(own: str, mask: float) -> Column:
        rest = F.filter(own, lambda x, k: k != F.col("at"))
        return F.concat(F.array(F.struct(F.lit(float(mask)).alias("mz"), F.col("out.i").alias("i"))), rest)

    frags = whole.select("motif", "frags", "losses", F.posexplode("frags").alias("at", "out"))
    losses = whole.select("motif", "frags", "losses", F.posexplode("losses").alias("at", "out"))
    return frags.select("motif", F.col("at").alias("variant"), without("frags", masks[0]).alias("frags"), "losses").unionByName(losses.select("motif", (F.col("at") + F.size("frags")).alias("variant"), "frags", without("losses", masks[1]).alias("losses")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def masked_similarity(hits: DataFrame, variants: DataFrame) -> DataFrame:
    """(motif, hit, variant, score): cosine of each of a motif's hits (motif, hit, v) with each of its variants (motif, variant, v)."""
    a = hits.select("motif", "hit", unit(F.col("v")).alias("a"))
    return a.join(variants.select("motif", "variant", unit(F.col("v")).alias("b")), "motif").select("motif", "hit", "variant", dot(F.col("a"), F.col("b")).alias("score"))


def hit_pairs(similarity: DataFrame) -> DataFrame:
    """(motif, rank, other, score): cosine of two hits' rows of masked_similarity, whose `hit` is the rank; a motif has a handful of hits."""
    rows = similarity.groupBy("motif", F.col("hit").alias("rank")).agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("variant", "score"))), lambda x: x["score"])).alias("v"))
    other = rows.select("motif", F.col("rank").alias("other"), F.col("v").alias("w"))
    return rows.join(other, "motif").select("motif", "rank", "other", dot(F.col("v"), F.col("w")).alias("score"))


def annotate(motifs: DataFrame, library: DataFrame, molecules: DataFrame, variants: DataFrame, n: int = 10, k: int = 100, cut: float = 0.4, how: str = "best") -> DataFrame:
    """(motif, rank, id, molecule, score, cluster): the library hits of each motif that belong together.

    motifs (query, v), library (id, v), molecules (id, molecule), variants (motif, variant, v) of the motifs, whose query they
    carry as motif. The first n different molecules among the k nearest are compared by their similarity to the motif's variants,
    clustered, and one cluster is kept.
    """
    hits = unique_hits(cosine_top(library, motifs, k), molecules, n)
    near = hits.select(F.col("query").alias("motif"), F.col("place").alias("hit"), "id").join(library, "id").select("motif", "hit", "v")
    chosen = selected_hits(clustered_hits(hit_pairs(masked_similarity(near, variants)), cut), how)
    named = hits.select(F.col("query").cast("string").alias("motif"), F.col("place").cast("int").alias("rank"), "id", "molecule", "score")
    return named.join(chosen, ["motif", "rank"])


def smaller_containment(a: Column, b: Column) -> Column:
    """Common positions over those of the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all; two empty sets are the same."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(1.0))


def structure_scores(topics: DataFrame, members: DataFrame) -> DataFrame:
    """(topic, spectra, compounds, sos, sos_spectra, small, small_spectra, quality) of topics (topic, print, features).

    members (topic, spectrum, compound, print): spectra of a topic with the set positions of their molecules, null where there is none. A
    compound counts once, with its first spectrum's; a topic without optimised features has no annotation and no score.
    """
    known = members.filter("print is not null").withColumn("_nth", F.row_number().over(Window.partitionBy("topic", "compound").orderBy("spectrum")))
    annotated = topics.select("topic", F.when(F.col("features") > 0, F.col("print")).alias("own"))
    rows = annotated.join(known, "topic", "left").withColumns({"a": containment(F.col("own"), F.col("print")), "b": smaller_containment(F.col("own"), F.col("print"))})
    there = F.col("own").isNotNull() & F.col("print").isNotNull()
    mean = lambda c, first: F.avg(F.when(there & ((F.col("_nth") == 1) if first else F.lit(True)), F.col(c)))
    out = rows.groupBy("topic").agg(F.count("spectrum").alias("spectra"), F.count(F.when(F.col("_nth") == 1, 1)).alias("compounds"), mean("a", True).alias("sos"), mean("a", False).alias("sos_spectra"), mean("b", True).alias("small"), mean("b", False).alias("small_spectra"))
    quality = F.when(F.col("sos").isNull(), "unavailable").when(F.col("sos") > 0.8, "high").when(F.col("sos") > 0.6, "intermediate").otherwise("low")
    return out.withColumn("quality", quality)


def without_held_out(library: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Library rows whose key is not held out; rows without a key stay."""
    return library.join(held_out.select(key).distinct(), key, "left_anti")


def exclusion_audit(kept: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """One row: retained rows, and those among them that are held out all the same, which must be none."""
    marked = kept.join(held_out.select(key).distinct().withColumn("_held", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("retained"), F.count("_held").alias("leaked"))


def best_analog(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, score, molecule): the candidate (query, molecule, score) with the best score, ties to the first molecule; 0 and O where there is none."""
    best = candidates.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "molecule")).alias("b"))
    return queries.select("query").distinct().join(best, "query", "left").select("query", F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"), F.coalesce("b.molecule", F.lit("O")).alias("molecule"))


def mass_differences(spectra: DataFrame, masses: list[float]) -> DataFrame:
    """spectra (scan, precmz) with place, the number of a molecule's mass, and mass_diff: how far the neutral mass is from it."""
    listed = F.array(*(F.lit(float(m)) for m in masses)) if masses else F.array().cast("array<double>")
    return spectra.select(*spectra.columns, F.posexplode(listed).alias("place", "_m")).withColumn("mass_diff", F.abs(F.col("precmz") - PROTON - F.col("_m"))).drop("_m")


def wide_scores(scores: DataFrame, queries: list[object]) -> DataFrame:
    """(id, one column for each of queries): scores (query, id, score) as a matrix."""
    return scores.groupBy("id").pivot("query", queries).agg(F.first("score"))


def set_retrieval(prints: DataFrame, substructures: DataFrame) -> DataFrame:
    """(id, position, substructure): the substructures (position, substructure) of a fingerprint's set bits (id, bits)."""
    return prints.select("id", F.posexplode("bits").alias("position", "bit")).filter("bit > 0").join(substructures, "position").select("id", "position", "substructure")


def bit_vector(positions: Column, n: int) -> Column:
    """An array of n zeros and ones from set positions."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains(positions, k).cast("int"))


def agreeing_keys(automated: DataFrame, manual: DataFrame, key: str, values: str) -> DataFrame:
    """Rows of both sides' keys whose automated list of values is not empty: (key, values, manual)."""
    return automated.filter(F.size(values) > 0).join(manual.select(key, F.col(values).alias("manual")), key)


def word_vectors(documents: DataFrame, size: int = 300, iterations: int = 10, window: int = 500, least: int = 1, seed: int = 1) -> DataFrame:
    """(word, v): vectors trained on documents (doc, words array), by Spark's own skip-gram model."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, maxIter=iterations, windowSize=window, minCount=least, seed=seed, inputCol="words", outputCol="v").fit(documents)
    return model.getVectors().select("word", vector_to_array("vector").alias("v"))


def reference_library(spectra: DataFrame, vectors: DataFrame, digits: int = 2, power: float = 0.5, **cleaning: float) -> DataFrame:
    """(doc, v): spectra cleaned, turned into words weighted by relative intensity, and embedded."""
    from .peaks import clean, words

    return weighted_means(words(clean(spectra, **cleaning), digits).select(F.col("scan").alias("doc"), "word", (F.col("n") / 100).alias("w")), vectors, power)


REFERENCE = ("motifset", "motif_id", "short_annotation", "auto_annotation", "annotation", "charge")


def motif_words(peaks: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """(doc, word, w) of fragments and losses with their intensities, each word once."""
    sides = [peaks.select(F.col(key).alias("doc"), fixed_word(kind, F.col(mz), digits).alias("word"), F.col(i).cast("double").alias("w")).filter(F.col(mz).isNotNull()) for kind, mz, i in (("frag", "frag_mz", "frag_intens"), ("loss", "loss_mz", "loss_intens")) if mz in peaks.columns]
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side)
    return both.groupBy("doc", "word").agg(F.sum("w").alias("w"))


def screen_store(store: tuple[DataFrame | None, DataFrame], query: str, vectors: DataFrame, spectra: DataFrame | None = None, motifs: DataFrame | None = None, least: float = 0.5, digits: int = 2, power: float = 0.5) -> DataFrame:
    """(hit_id, screen_type, score, ref_*): spectra and motifs that are like the motifs of a store that a peak query finds, one call from query to list.

    store: (ms1, ms2) tables of motifs with motif_id, and whatever else is known of them; spectra and motifs: peaks (scan or motif_id, frag_mz,
    frag_intens, loss_mz, loss_intens); vectors (word, v). Cosines of mean word vectors from `least` on, rounded to two digits; `ranked_hits` puts them
    in order. A query that finds no motif is an error.
    """
    ms1, ms2 = store
    found = run(query, ms1, ms2).select("scan").distinct()
    kept = settle(ms2.join(found, "scan", "left_semi"), "screen-motifs")
    if kept.isEmpty():
        raise ValueError("no motif of the store matches the query")
    known = kept.groupBy("motif_id").agg(*(F.max(c).alias(f"ref_{c}") for c in REFERENCE if c in ms2.columns and c != "motif_id"))
    number = F.xxhash64("doc")  # vectors meet under numbers; names come back in a join
    library = settle(weighted_means(motif_words(kept, "motif_id", digits), vectors, power).withColumn("id", number), "screen-store")
    out = None
    for kind, peaks, key in (("spectrum-motif", spectra, "scan"), ("motif-motif", motifs, "motif_id")):
        if peaks is None:
            continue
        asked = settle(weighted_means(motif_words(peaks, key, digits), vectors, power).withColumn("query", number), "screen-asked")
        hits = cosine_pairs(library.select("id", "v"), asked.select("query", "v"), least)
        hits = hits.join(asked.select("query", F.col("doc").cast("string").alias("hit_id")), "query").join(library.select("id", F.col("doc").alias("motif_id")), "id")
        part = hits.select("hit_id", F.lit(kind).alias("screen_type"), F.round("score", 2).alias("score"), "motif_id").join(known, "motif_id").withColumnRenamed("motif_id", "ref_motif_id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("spectra or motifs are needed")
    return out


def ranked_hits(hits: DataFrame) -> DataFrame:
    """Hits with their place: best score first, then by name."""
    return numbered(hits, F.desc("score"), "hit_id", "ref_motif_id", "screen_type", name="place")


VARIANTS = 1 << 20  # more than any motif has


def optimised_motifs(motifs: DataFrame, spectra: DataFrame, vectors: DataFrame, digits: int = 2, n: int = 10, k: int = 100, cut: float = 0.4, power: float = 0.5, how: str = "best") -> tuple[DataFrame, DataFrame]:
    """(hits, peaks): the library spectra of each motif that belong together, and the motif's peaks that all of these have.

    motifs (motif_id with a number, kind, peak_idx, mz, i); spectra: peaks of a library (scan, precmz, frag_mz, frag_intens); vectors (word, v). From
    motif to optimised motif in one call: variants with one feature masked, mean word vectors, nearest library spectra, clusters, shared features.
    """
    own = motifs.withColumn("motif", natural_number(F.col("motif_id")))
    word = lambda kind, mz: F.when(kind == "frag", fixed_word("frag", mz, digits)).otherwise(fixed_word("loss", mz, digits))
    asked = settle(weighted_means(own.select(F.col("motif").alias("doc"), word(F.col("kind"), F.col("mz")).alias("word"), F.col("i").alias("w")), vectors, power), "motifs-asked")
    number = F.col("motif") * VARIANTS + F.col("variant")
    masked = masked_spectra(own.select("motif", "kind", "peak_idx", "mz", "i"))
    cells = [masked.select(number.alias("doc"), F.inline(side)).select("doc", fixed_word(kind, F.col("mz"), digits).alias("word"), F.col("i").alias("w")) for kind, side in (("frag", "frags"), ("loss", "losses"))]
    variants = weighted_means(cells[0].unionByName(cells[1]), vectors, power)
    variants = variants.select(F.floor(F.col("doc") / VARIANTS).alias("motif"), (F.col("doc") % VARIANTS).alias("variant"), "v")

    known = spectra.withColumns({"id": F.xxhash64("scan"), "loss_mz": F.col("precmz") - F.col("frag_mz"), "loss_intens": F.col("frag_intens")})
    library = settle(weighted_means(motif_words(known, "id", digits), vectors, power).withColumnRenamed("doc", "id"), "motifs-library")
    found = annotate(asked.withColumnRenamed("doc", "query"), library, library.select("id", F.col("id").cast("string").alias("molecule")), variants, n, k, cut, how)
    hits = found.join(known.select("id", "scan").distinct(), "id").select(F.col("motif").cast("bigint").alias("motif"), "rank", "scan", "score", "cluster")
    listed = known.select("scan", F.inline(F.array(F.struct(F.lit("frag").alias("kind"), F.col("frag_mz").alias("mz")), F.struct(F.lit("loss").alias("kind"), F.col("loss_mz").alias("mz")))))
    shared = optimised(own, hits.join(listed, "scan").select("motif", F.col("scan").alias("hit"), "kind", "mz"), digits)
    return hits, shared.drop("motif")
