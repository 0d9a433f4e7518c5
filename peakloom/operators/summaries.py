"""Summaries of runs and tables: diagnostics of mixtures, aggregates over seeds, convergence, audits, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered
from .topics import FLOOR


def mixture_diagnostics(theta: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: topics that dominate a document, quantiles of the largest share, median of exp(entropy), and how many documents and topics have a share of at least `threshold`."""
    p = F.when(F.col("p") == 0, FLOOR).otherwise(F.col("p"))
    docs = theta.groupBy("doc").agg(F.max(F.struct("p", (-F.col("topic")).alias("t"))).alias("b"), F.exp(F.sum(-p * F.log(p))).alias("wide"))
    quantile = lambda c, q: F.percentile(c, F.lit(q))
    shape = docs.agg(
        F.countDistinct("b.t").alias("dominant_topics"), quantile("b.p", 0.5).alias("max_median"), quantile("b.p", 0.95).alias("max_p95"),
        F.max("b.p").alias("max_max"), quantile("wide", 0.5).alias("wide_median"), F.count(F.when(F.col("b.p") >= threshold, 1)).alias("crossing_docs"),
    )
    topics = theta.filter(F.col("p") >= threshold).agg(F.countDistinct("topic").alias("crossing_topics"))
    return shape.crossJoin(topics)  # one row each


def across_seeds(rows: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by, median, min, max, n) of a value; nulls take no part."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def latencies(rows: DataFrame, *by: str, seconds: str = "seconds", items: str = "items") -> DataFrame:
    """(by, median, p95, per_second) of timed calls."""
    return rows.groupBy(*by).agg(F.percentile(seconds, F.lit(0.5)).alias("median"), F.percentile(seconds, F.lit(0.95)).alias("p95"), (F.sum(items) / F.sum(seconds)).alias("per_second"))


def converged(history: DataFrame, least: float, n: int, *by: str) -> DataFrame:
    """history (by, step, value) with `stable`: the last n relative changes are all below least, once there are n."""
    order = Window.partitionBy(*by).orderBy("step")
    before = F.lag("value").over(order)
    moved = history.withColumn("_c", F.abs(F.col("value") - before) / F.abs(before))
    last = order.rowsBetween(1 - n, 0)
    return moved.withColumn("stable", F.count(F.when(F.col("_c") < least, 1)).over(last) == n).drop("_c")


def audit(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, keys, missing keys, keys that repeat, and rows beyond the first of their key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    known = F.col(key).isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counts.agg(
        total("n").alias("n_rows"), F.count(F.when(known, 1)).alias("n_keys"), total(F.when(~known, F.col("n"))).alias("n_missing"),
        F.count(F.when(known & (F.col("n") > 1), 1)).alias("n_repeated"), total(F.when(known, F.col("n") - 1)).alias("n_extra"),
    )


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin, n): values in (edges[k], edges[k + 1]], bins without any too; the rest is left out."""
    bins = rows.sparkSession.createDataFrame(list(enumerate(edges[:-1])), "bin int, low double").select("bin")
    at = F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e < value)) - 1
    counts = rows.filter(value.isNotNull()).select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").na.fill(0, ["n"])


def frequent(rows: DataFrame, doc: str, item: str, least: float = 0.005) -> DataFrame:
    """(item, n): items in more documents than that share of all, rounded down; `in_order` lists them."""
    counts = rows.select(doc, item).distinct().groupBy(item).agg(F.count("*").alias("n"))
    total = rows.agg(F.countDistinct(doc).alias("_d"))
    return counts.crossJoin(total).filter(F.col("n") > F.floor(F.col("_d") * least)).drop("_d")  # the total is one row


def in_order(counts: DataFrame, item: str, n: str = "n") -> DataFrame:
    """Counts with the most common item first; ties by item."""
    return counts.orderBy(F.desc(n), item)


def first_places(corpus: DataFrame) -> DataFrame:
    """(word, place): words in order of first appearance; corpus (doc, pos, word), documents in order of doc."""
    first = corpus.groupBy("word").agg(F.min(F.struct("doc", "pos")).alias("f"))
    return numbered(first, "f", name="_n").select("word", (F.col("_n") + 1).cast("int").alias("place"))


def curated(spectra: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`; rows without a key go."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return spectra.filter(F.col(key).isNotNull()).withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def unknown_words(corpus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, n, unknown): tokens of each document and those whose word is not in the vocabulary."""
    marked = corpus.join(vocabulary.select("word").distinct().withColumn("_known", F.lit(1)), "word", "left")
    return marked.groupBy("doc").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))


def feature_counts(documents: DataFrame, theta: DataFrame, topic: object, low: float, high: float = 1.0, beta: DataFrame | None = None, beta_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(word, docs): in how many documents whose share of a topic is in the inclusive range a word occurs.

    With beta (topic, word, p), only words whose p in the topic is in its inclusive range, and that occur at all.
    """
    passing = theta.filter((F.col("topic") == F.lit(topic)) & F.col("p").between(low, high)).select("doc")
    kept = documents.join(passing, "doc", "left_semi")
    if beta is not None:
        kept = kept.join(beta.filter((F.col("topic") == F.lit(topic)) & F.col("p").between(*beta_range)).select("word").distinct(), "word", "left_semi")
    return kept.groupBy("word").agg(F.countDistinct("doc").alias("docs"))


def library_spectra(spectra: DataFrame) -> DataFrame:
    """Spectra fit for a library: MS2, positive mode, with a structure; (ms_level, ionmode, smiles, ...)."""
    return spectra.filter((F.col("ms_level") == 2) & (F.lower(F.trim("ionmode")) == "positive") & (F.trim("smiles") != ""))


def row_ledger(rows: DataFrame, size: int) -> DataFrame:
    """(start, end, sha256) of rows (n from 0 on, value): a digest for each `size` rows, in order of n."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy(F.floor(F.col("n") / size).alias("_k")).agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end"), F.count("*").alias("rows"), F.sha2(text, 256).alias("sha256")).drop("_k")


def ledger_faults(rows: DataFrame, ledger: DataFrame, size: int) -> DataFrame:
    """Ranges (start, end, fault) of a ledger that don't hold: a gap or overlap before them, or other rows than were recorded."""
    before = F.lag("end", 1, 0).over(Window.orderBy("start"))  # a row for each range
    now = row_ledger(rows, size).select("start", F.col("end").alias("_end"), F.col("sha256").alias("_now"))
    checked = ledger.withColumn("_before", before).join(now, "start", "full_outer")
    fault = F.when(F.col("end").isNull(), "missing").when(F.col("_before") != F.col("start"), "gap").when(~F.col("_now").eqNullSafe(F.col("sha256")) | (F.col("_end") != F.col("end")), "changed")
    return checked.select("start", F.coalesce("end", "_end").alias("end"), fault.alias("fault")).filter("fault is not null")


def document_spectra(documents: DataFrame, spectra: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, spectrum): the spectrum of each document's key; documents (doc, key), keys (place, spectrum, key), of equal keys the last place."""
    last = keys.groupBy("key").agg(F.max(F.struct("place", "spectrum")).alias("b")).select("key", F.col("b.spectrum").alias("spectrum"))
    return documents.join(last, "key").select("doc", "spectrum").join(spectra, "spectrum")


def violations(rows: DataFrame, key: str, mz: str = "mz", values: str = "values") -> DataFrame:
    """One row of counts that are 0 for sound feature rows: repeated keys, unequal lengths, values not finite, m/z not above 0."""
    bad = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    count = lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    return rows.agg(
        (F.count("*") - F.countDistinct(key)).alias("repeated"), count(F.size(mz) != F.size(values)).alias("unequal"), count(bad(values) | bad(mz)).alias("not_finite"),
        count(F.exists(mz, lambda x: x <= 0)).alias("not_positive"),
    )
