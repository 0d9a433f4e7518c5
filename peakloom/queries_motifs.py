"""Registered queries about motifs, their annotation, splits, metrics and tables, each beside SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars, sketches
from .operators import annotation, lda, metrics, motifs, network, ordered, peaks, runs, screening, similarity, summaries, topic_table, topics
from .registry import PEAKS, THETA, named, q6, r6, register
from .sources import readers, sinks
from .sources.adapters import beta, ms2_peaks, over, scan_parts, theta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms2_peaks(spark, sf_dir).withColumn("peak_idx", F.row_number().over(Window.partitionBy("scan").orderBy("frag_mz", "frag_intens", "loss_mz")))


NUMBERED = f"{PEAKS}, np as (select *, row_number() over (partition by scan order by frag_mz, frag_intens, loss_mz)::int as peak_idx from ms2)"


def sides(df: DataFrame, *keep: str) -> DataFrame:
    """Fragments and losses of peak rows as rows of their own: (keep, kind, mz, i)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_mz").alias("mz"), F.col(f"{k}_intens").alias("i")) for k in ("frag", "loss")])
    return df.select(*keep, F.inline(kinds)).filter("mz is not null")


SIDES = f"{NUMBERED}, sd as (select scan, charge, peak_idx, 'frag' as kind, frag_mz as mz, frag_intens as i from np union all select scan, charge, peak_idx, 'loss', loss_mz, loss_intens from np where loss_mz is not null)"
POSITIONS = "list_filter(range(0, 64), lambda k: embedding[k + 1] > {})"


def positions(limit: float):
    return similarity.bits(F.transform("embedding", lambda x: (x > limit).cast("int")))


@register(
    "motif_spectra",
    f"""{THETA}, t as (select topic, case when word % 3 = 0 then 'loss' else 'frag' end as kind, floor((word * 137 % 90000) / 100e0 * 100 + 0.5e0) / 100 as mz, p from (select *, row_number() over (partition by topic order by p desc, word) as k from beta) where k <= 10)
    select 'motif_' || topic as motif_id, 0.005e0 as ms2accuracy, kind, row_number() over (partition by topic, kind order by mz, p)::int as peak_idx, mz, {q6('p / max(p) over (partition by topic)')} as i from t""",
)
def motif_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("word") % 3 == 0, "loss").otherwise("frag")
    named_words = F.concat(kind, F.lit("@"), ((F.col("word") * 137 % 90000) / 100.0).cast("string"))
    features = topics.top_words(beta(spark, sf_dir)).select("topic", named_words.alias("word"), "p")
    return motifs.motif_spectra(features).select("motif_id", "ms2accuracy", "kind", "peak_idx", "mz", r6("i").alias("i"))


@register(
    "motif_keys",
    f"""{SIDES} select scan as motif_id, substr(sha256(string_agg(printf('%s:%.5f:%.5f', kind, mz, i::double), ';' order by printf('%s:%.5f:%.5f', kind, mz, i::double))), 1, 20) as spectrum_key,
    substr(sha256('charge=' || max(charge)::varchar), 1, 20) as metadata_key from sd where charge = 1 group by scan""",
)
def motif_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif_id"), "charge").withColumn("i", F.col("i").cast("double"))
    return motifs.motif_keys(rows, "charge")


@register(
    "motif_equal",
    f"""{SIDES}, k as (select scan, sha256(string_agg(printf('%s:%.5f:%.5f', kind, floor(mz / 40e0), 1e0), ';' order by printf('%s:%.5f:%.5f', kind, floor(mz / 40e0), 1e0))) as key from sd where kind = 'frag' group by scan)
    select a.scan as a, b.scan as b from k a join k b using (key) where a.scan < b.scan""",
)
def motif_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir), F.col("scan").alias("motif_id")).filter("kind = 'frag'").select("motif_id", "kind", F.floor(F.col("mz") / 40.0).cast("double").alias("mz"), F.lit(1.0).alias("i"))
    return motifs.equal_motifs(rows, rows).filter("a < b")


@register(
    "motif_exact_matches",
    f"""{SIDES}, f as (select distinct scan, charge, kind, floor(mz * 10e0) as mz from sd)
    select a.scan as motif, b.scan as analog, a.kind, count(*)::int as n, sum(a.mz)::bigint as total from f a join f b on a.kind = b.kind and a.mz = b.mz where a.charge = 1 and b.charge = 2 group by 1, 2, 3""",
)
def motif_exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(ms2_peaks(spark, sf_dir, keyed=True), "_key", "scan", "charge").withColumn("mz", F.floor(F.col("mz") * 10.0))
    found = F.count("*").cast("int").alias("n"), F.sum("mz").alias("total")
    return motifs.exact_matches(rows.filter("charge = 1").withColumnRenamed("scan", "motif"), rows.filter("charge = 2").withColumnRenamed("scan", "analog"), *found)


@register(
    "motif_tables_query",
    f"{SIDES} select scan as motif_id, max(mz) as top from sd where kind = 'frag' and charge = 1 and scan in (select scan from sd where kind = 'loss' and mz > 505 - 50e0 and mz < 505 + 50e0) group by scan",
)
def motif_tables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs as a table of the query language, and a query over it."""
    from .plans.compiler import run

    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif_id"), "motifset", "charge", "peak_idx")
    ms1, ms2 = motifs.motif_tables(rows)
    hits = run("QUERY scannum(MS2DATA) WHERE MS2NL=505:TOLERANCEMZ=50", None, ms2.withColumns({"precmz": F.lit(0.0), "rt": F.lit(0.0), "polarity": F.lit(1)}))
    return ms2.join(hits.select("scan"), "scan", "left_semi").groupBy("motif_id").agg(F.max("frag_mz").alias("top"))


@register(
    "document_spectra",
    f"""{NUMBERED}, d as (select scan, md5('frag@' || floor(frag_mz / 50e0)::bigint) as key, precmz from np where peak_idx = 1), l as (select key, max(scan::bigint) as place from d group by key)
    select d.scan as doc, l.place::varchar as spectrum, {q6('s.precmz')} as precmz from d join l using (key) join d s on s.scan = l.place::varchar""",
)
def document_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.concat(F.lit("frag@"), F.floor(F.col("frag_mz") / 50.0).cast("string")))
    docs = numbered(spark, sf_dir).filter("peak_idx = 1").select("scan", scalars.document_key(words).alias("key"), "precmz")
    keys = docs.select(F.col("scan").cast("bigint").alias("place"), F.col("scan").alias("spectrum"), "key")
    found = summaries.document_spectra(docs.select(F.col("scan").alias("doc"), "key"), docs.select(F.col("scan").alias("spectrum"), "precmz"), keys)
    return found.select("doc", "spectrum", r6("precmz").alias("precmz"))


@register("theta_metadata", f"{THETA} select doc, topic, {named('p')}, label from theta join embeddings on vec_id = doc where topic < 4")
def theta_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    return topics.with_metadata(theta(spark, sf_dir).filter("topic < 4"), known).select("doc", "topic", r6("p").alias("p"), "label")


@register(
    "annotation_agreement",
    "select o_custkey, count(*) filter (o_orderstatus = 'F')::int as automated, count(*) filter (o_orderstatus = 'O')::int as manual from orders group by o_custkey having count(*) filter (o_orderstatus = 'F') > 0 and count(*) filter (o_orderstatus = 'O') > 0",
)
def annotation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda status: table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == status, F.col("o_orderkey"))).alias("keys"))
    manual = side("O").filter(F.size("keys") > 0)
    return annotation.agreeing_keys(side("F"), manual, "o_custkey", "keys").select("o_custkey", F.size("keys").alias("automated"), F.size("manual").alias("manual"))


@register("held_out_exclusion", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def held_out_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return annotation.without_held_out(table(spark, sf_dir, "orders"), held, "o_custkey").select("o_orderkey")


@register("exclusion_audit", "select count(*) as retained, count(*) filter (o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')) as leaked from orders where o_orderstatus = 'F'")
def exclusion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return annotation.exclusion_audit(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), held, "o_custkey")


@register(
    "best_analog",
    """with c as (select l_orderkey as query, l_returnflag as molecule, l_discount::double as score from lineitem where l_quantity > 40), r as (select *, row_number() over (partition by query order by score desc, molecule) as k from c)
    select o_orderkey as query, coalesce(score, 0) as score, coalesce(molecule, 'O') as molecule from orders left join (select * from r where k = 1) on query = o_orderkey""",
)
def best_analog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("molecule"), F.col("l_discount").cast("double").alias("score"))
    return annotation.best_analog(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query")), found)


@register("mass_differences", f"select o_orderkey as scan, place::int as place, {q6('abs(o_totalprice / 100e0 - 1.007276470e0 - mass)')} as mass_diff from orders, (values (0, 300e0), (1, 1200.5e0)) m(place, mass)")
def mass_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), (F.col("o_totalprice") / 100.0).alias("precmz"))
    return annotation.mass_differences(spectra, [300.0, 1200.5]).select("scan", "place", r6("mass_diff").alias("mass_diff"))


UNIT = "u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings))"


def cosine_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda k: {a}.e[k] * {b}.e[k]))"


@register("embedding_similar_pairs", f"with {UNIT} select q.vec_id as query, l.vec_id as id, {q6(cosine_sql('q', 'l'))} as score from u q, u l where q.vec_id % 10 = 0 and {cosine_sql('q', 'l')} >= 0.3e0")
def embedding_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity.cosine_pairs(rows, rows.filter("id % 10 = 0").withColumnRenamed("id", "query"), 0.3).select("query", "id", r6("score").alias("score"))


@register("masked_similarity", f"with {UNIT} select a.label as motif, a.vec_id as hit, b.vec_id as variant, {q6(cosine_sql('a', 'b'))} as score from u a join u b using (label) where a.vec_id % 40 = 0 and b.vec_id % 40 = 1")
def masked_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("motif"), "vec_id", F.col("embedding").alias("v"))
    side = lambda rest, name: rows.filter(f"vec_id % 40 = {rest}").withColumnRenamed("vec_id", name)
    return annotation.masked_similarity(side(0, "hit"), side(1, "variant")).select("motif", "hit", "variant", r6("score").alias("score"))


@register(
    "masked_variants",
    f"""{SIDES}, s as (select * from sd where charge = 1), t as (select scan, count(*) filter (kind = 'frag') as nf, sum(mz) filter (kind = 'frag') as fm, coalesce(sum(mz) filter (kind = 'loss'), 0) as lm, sum(i) as total from s group by scan),
    v as (select scan, kind, mz, row_number() over (partition by scan, kind order by peak_idx) - 1 as plc from s)
    select scan as motif, (case kind when 'frag' then plc else plc + nf end)::int as variant, {q6("case kind when 'frag' then fm - mz - 1 else fm end")} as frag_mz, {q6("case kind when 'loss' then lm - mz - 2 else lm end")} as loss_mz, {q6('total')} as i from v join t using (scan)""",
)
def masked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif"), "peak_idx").withColumn("i", F.col("i").cast("double"))
    total = lambda c, key: F.aggregate(c, F.lit(0.0), lambda a, x: a + x[key])
    out = annotation.masked_spectra(rows, (-1.0, -2.0))
    return out.select("motif", "variant", r6(total("frags", "mz")).alias("frag_mz"), r6(total("losses", "mz")).alias("loss_mz"), r6(total("frags", "i") + total("losses", "i")).alias("i"))


@register(
    "structure_scores",
    f"""with e as (select vec_id, label, {POSITIONS.format('0.05e0')} as s, vec_id % 7 as compound from embeddings), o as (select distinct label as topic, list_filter(range(0, 64), lambda k: (k + label) % 3 = 0) as own from embeddings),
    k as (select *, row_number() over (partition by label, compound order by vec_id) as nth from e where vec_id % 11 <> 0),
    r as (select topic, own, vec_id, nth, topic % 4 > 0 as fit, len(list_intersect(own, s)) as c, len(own) as n, len(s) as m from o left join k on label = topic),
    g as (select topic, count(vec_id) as spectra, count(*) filter (nth = 1) as compounds, avg(c * 1e0 / n) filter (fit and nth = 1) as sos, avg(c * 1e0 / n) filter (fit and vec_id is not null) as sos_spectra,
          avg(case when least(n, m) > 0 then c * 1e0 / least(n, m) else 0 end) filter (fit and nth = 1) as small, avg(case when least(n, m) > 0 then c * 1e0 / least(n, m) else 0 end) filter (fit and vec_id is not null) as small_spectra from r group by topic)
    select topic, spectra, compounds, {named('sos')}, {named('sos_spectra')}, {named('small')}, {named('small_spectra')}, case when sos is null then 'unavailable' when sos > 0.8e0 then 'high' when sos > 0.6e0 then 'intermediate' else 'low' end as quality from g""",
)
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    members = rows.select(F.col("label").alias("topic"), F.col("vec_id").alias("spectrum"), (F.col("vec_id") % 7).alias("compound"), F.when(F.col("vec_id") % 11 != 0, positions(0.05)).alias("print"))
    own = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: (k + F.col("topic")) % 3 == 0)
    asked = members.select("topic").distinct().select("topic", own.alias("print"), (F.col("topic") % 4).alias("features"))
    return annotation.structure_scores(asked, members).select("topic", "spectra", "compounds", *(r6(c).alias(c) for c in ("sos", "sos_spectra", "small", "small_spectra")), "quality")


@register(
    "fingerprint_jaccard",
    f"with e as (select vec_id, {POSITIONS.format('0.2e0')} as s from embeddings), p as (select a.vec_id, len(list_intersect(a.s, b.s)) as c, len(list_distinct(list_concat(a.s, b.s))) as n from e a join e b on b.vec_id = a.vec_id + 1) select vec_id, {q6('case when n > 0 then c * 1e0 / n else 1 end')} as score from p",
)
def fingerprint_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", positions(0.2).alias("s"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    return a.join(b, "vec_id").select("vec_id", r6(annotation.jaccard(F.col("s"), F.col("t"))).alias("score"))


@register("substructure_retrieval", f"select vec_id as id, k::int as position, 's' || k as substructure from (select vec_id, unnest({POSITIONS.format('0.2e0')}) as k from embeddings) where k % 2 = 0")
def substructure_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), annotation.bit_vector(positions(0.2), 64).alias("bits"))
    listed = spark.range(0, 64, 2).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("substructure"))
    return annotation.set_retrieval(prints, listed)




@register(
    "sketch_merged",
    f"""with p as (select p_brand, p_name from part), g as (select p_brand, list_distinct([substr(p_name, k, 4) for k in range(1, length(p_name) - 2)]) as s from p),
    h as (select p_brand, unnest([('0x' || substr(sha1(x), 1, 8))::bigint % {sketches.PRIME} for x in s]) as h from g),
    m as (select p_brand, unnest([{", ".join(f"(h * {a} + {b}) % {sketches.PRIME}" for a, b in sketches.permutations(4))}]) as v, unnest(range(4)) as pos from h), l as (select p_brand, pos, min(v) as v from m group by 1, 2)
    select p_brand, sum(v)::bigint as total from l group by p_brand""",
)
def sketch_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", sketches.minhash(sketches.lingo(F.col("p_name")), sketches.permutations(4)).alias("sketch"))
    return sketches.merged_all(rows, "p_brand", "sketch").select("p_brand", F.aggregate("sketch", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@register(
    "strict_peaks",
    f"""{NUMBERED}, n as (select *, frag_intens / max(frag_intens) over (partition by scan) as w from np), k as (select *, row_number() over (partition by scan order by w desc, peak_idx) as r from n where frag_mz between 0 and 1000 and w between 0.1e0 and 1),
    c as (select *, count(*) over (partition by scan) as n from k where r <= 5) select scan, row_number() over (partition by scan order by frag_mz, peak_idx)::int as peak_idx, {named('frag_mz')}, {named('w')} from c where n >= 3""",
)
def strict_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.strict_clean(numbered(spark, sf_dir), low=0.1, top=5).select("scan", "peak_idx", r6("frag_mz").alias("frag_mz"), r6("w").alias("w"))


@register("limited_peaks", f"{PEAKS}, k as (select scan, frag_mz, frag_intens, row_number() over (partition by scan order by frag_intens desc, frag_mz desc) as r from ms2 where frag_mz >= 10 and frag_intens >= 10) select scan, {q6('frag_mz')} as mz, frag_intens::double as i from k where r <= 2")
def limited_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms2_peaks(spark, sf_dir).select("scan", F.col("frag_mz").alias("mz"), F.col("frag_intens").alias("i"))
    return peaks.limited(rows, 10.0, 2).select("scan", r6("mz").alias("mz"), F.col("i").cast("double").alias("i"))


OBSERVED = f"""{NUMBERED}, dg as (select *, count(*) over (partition by scan) as n, row_number() over (partition by scan order by sha256('42' || chr(0) || scan || chr(0) || peak_idx::varchar)) as k from np),
    ob as (select * from dg where n > 1 and k <= greatest(least(round_even(n * 0.5e0, 0), n - 1), 1))"""


@register(
    "renormalised_peaks",
    f"{OBSERVED}, w as (select scan, peak_idx, frag_intens / max(frag_intens) over (partition by scan) as w, frag_mz, precmz from ob) select scan, peak_idx, {named('w')}, greatest(round_even(w * 100e0, 0)::bigint, 1) as n, 'frag@' || (floor(frag_mz + 0.5e0)::double)::varchar as word, precmz - frag_mz > 0.01e0 as has_loss from w",
)
def renormalised_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = numbered(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("scan"))).filter("n > 1").drop("n")
    out = peaks.renormalised(peaks.completion_split(several, 42).filter("observed"), 0)
    return out.select("scan", "peak_idx", r6("w").alias("w"), "n", "word", F.col("loss").isNotNull().alias("has_loss"))


NPMI_DOCS = "docs as (select distinct (word * 7 + k * 13) % 97 as doc, word from (select distinct word from beta), range(5) r(k))"


@register(
    "npmi_summary",
    f"""{THETA}, {NPMI_DOCS}, top as (select * from (select topic, word, row_number() over (partition by topic order by p desc, word) as rank from beta) where rank <= 5),
    pairs as (select a.topic, a.word as v, b.word as w from top a join top b on a.topic = b.topic and a.rank < b.rank), s as (select word, count(*) as c from docs group by word), d as (select count(distinct doc) as d from docs),
    b as (select v, w, count(*) as c from (select distinct v, w from pairs) join docs x on x.word = v join docs y on y.word = w and y.doc = x.doc group by v, w),
    t as (select topic, avg(case when b.c is null then -1 when b.c = d then 1 else ln((b.c * 1e0 / d) / (sv.c * 1e0 / d * sw.c / d)) / -ln(b.c * 1e0 / d) end) as npmi, count(*) filter (b.c is null) as undefined
          from pairs left join b using (v, w) left join s sv on sv.word = v left join s sw on sw.word = w cross join d group by topic)
    select {q6('avg(npmi)')} as mean, {q6('quantile_cont(npmi, 0.5)')} as median, sum(undefined)::bigint as undefined from t""",
)
def npmi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beta(spark, sf_dir)
    docs = b.select("word").distinct().select(F.explode(F.array(*[(F.col("word") * 7 + k * 13) % 97 for k in range(5)])).alias("doc"), "word").distinct()
    return topics.npmi_summary(topics.npmi(b, docs, 5)).select(r6("mean").alias("mean"), r6("median").alias("median"), "undefined")


@register(
    "distance_summary",
    f"""{THETA}, u as (select doc, topic, p as a, lag(p, 1, 0) over (partition by doc order by topic) as b from theta),
    g as (select doc, sum(a * b) as ab, sum(a * a) as aa, sum(b * b) as bb, sum(case when a > 0 then a * ln(a / ((a + b) / 2)) else 0 end + case when b > 0 then b * ln(b / ((a + b) / 2)) else 0 end) / 2 as js from u group by doc),
    c as (select case when aa > 0 and bb > 0 then ab / sqrt(aa * bb) else 0 end as c, js from g)
    select {q6('avg(c)')} as cosine_mean, {q6('quantile_cont(c, 0.5)')} as cosine_median, {q6('quantile_cont(c, 0.05)')} as cosine_p05, {q6('avg(js)')} as js_mean, {q6('quantile_cont(js, 0.5)')} as js_median, {q6('quantile_cont(js, 0.95)')} as js_p95 from c""",
)
def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    out = metrics.distance_summary(metrics.mixture_distances(t, t.filter("topic < 63").withColumn("topic", F.col("topic") + 1)))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@register(
    "completion_metrics",
    f"""{THETA}, n as (select id as doc, id * 31 % 700 + k * 300 as word, k + 1 as n from (select distinct id from cells), range(4) r(k)), w as (select distinct word from beta),
    t as (select n.doc, n.word, max(n.n) as n, sum(theta.p * beta.p) as p from n join theta on theta.doc = n.doc join beta on beta.word = n.word and beta.topic = theta.topic group by n.doc, n.word)
    select {q6('sum(-n * ln(greatest(p, 1e-12))) / sum(n)')} as nll, sum(n)::bigint as tokens, ((select sum(n) from n) - sum(n))::bigint as unknown_tokens, (select count(distinct doc) from n where word in (select word from w)) as eligible, (select count(distinct doc) from n) as documents from t""",
)
def completion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = theta(spark, sf_dir), beta(spark, sf_dir)
    cells = F.array(*[F.struct((F.col("doc") * 31 % 700 + k * 300).alias("word"), F.lit(k + 1).alias("n")) for k in range(4)])
    out = topics.likelihood(t.select("doc").distinct().select("doc", F.inline(cells)), t, b)
    return out.select(r6("nll").alias("nll"), "tokens", "unknown_tokens", "eligible", "documents")


@register(
    "word_evidence",
    f"""{THETA}, n as (select id as doc, id * 31 % 700 + k * 300 as word, k + 1 as n from (select distinct id from cells), range(4) r(k) where id % 5 > 0), tt as (select doc, sum(n) as total from n group by doc),
    s as (select doc, topic, sum(n * beta.p) as s from n join beta using (word) group by doc, topic), e as (select d.doc, t.topic, case when coalesce(total, 0) > 0 then coalesce(s, 0) else 1 end as s from (select distinct doc from theta) d cross join (select distinct topic from theta) t left join tt using (doc) left join s on s.doc = d.doc and s.topic = t.topic)
    select doc, topic, {q6('s / greatest(sum(s) over (partition by doc), 1e-12)')} as p from e""",
)
def word_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = theta(spark, sf_dir).select("doc").distinct()
    cells = F.array(*[F.struct((F.col("doc") * 31 % 700 + k * 300).alias("word"), F.lit(k + 1).alias("n")) for k in range(4)])
    return topics.word_evidence(docs.filter("doc % 5 > 0").select("doc", F.inline(cells)), beta(spark, sf_dir), docs).select("doc", "topic", r6("p").alias("p"))


@register("topic_entropy", f"{THETA} select {q6('avg(h)')} as entropy from (select topic, sum(-p * ln(case when p = 0 then 1e-12 else p end)) as h from beta group by topic)")
def topic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.entropy(beta(spark, sf_dir), "topic").select(r6("entropy").alias("entropy"))


@register("theta_exported", f"{THETA} select 'theta' as part, doc as a, topic as b, {named('p')} from theta where p > 1e-2 union all select 'beta', topic, word, {named('p')} from beta where p > 1e-3")
def theta_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = topics.exported(theta(spark, sf_dir), beta(spark, sf_dir))
    rows = lambda name, a, b: parts[name].select(F.lit(name).alias("part"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"), r6("p").alias("p"))
    return rows("theta", "doc", "topic").unionByName(rows("beta", "topic", "word"))


@register("topics_of_document", f"{THETA} select topic, {named('p')} from theta where doc = 20 and p >= 0.02e0")
def topics_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.of_document(theta(spark, sf_dir), 20, 0.02).select("topic", r6("p").alias("p"))


PHI = "phi as (select theta.doc, theta.topic, w.word, theta.p * w.k as p from theta join (select doc, (doc * 31 + k * 17) % 500 as word, (k + 1) * 5 as k from (select distinct doc from theta), range(4) r(k)) w using (doc))"


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(((F.col("doc") * 31 + k * 17) % 500).alias("word"), F.lit((k + 1) * 5).alias("k")) for k in range(4)])
    t = theta(spark, sf_dir)
    return t.select("doc", "topic", "p", F.inline(cells)).select("doc", "topic", "word", (F.col("p") * F.col("k")).alias("p"))


@register("topic_overlap", f"{THETA}, {PHI} select phi.doc, phi.topic, {q6('sum(beta.p * phi.p)')} as overlap from phi join beta using (topic, word) where phi.p >= 0.2e0 group by 1, 2")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.overlap(beta(spark, sf_dir), phi(spark, sf_dir), 0.2).select("doc", "topic", r6("overlap").alias("overlap"))


@register(
    "topic_assignments",
    f"with t as (select l_orderkey as doc, l_suppkey % 5 as word, l_linenumber % 3 as topic from lineitem), c as (select doc, word, topic, count(*) as n from t group by 1, 2, 3) select doc, word, topic, {q6('n * 1e0 / sum(n) over (partition by doc, word)')} as p from c",
)
def topic_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).alias("word"), (F.col("l_linenumber") % 3).alias("topic"))
    return topics.assignments(tokens).select("doc", "word", "topic", r6("p").alias("p"))


@register(
    "peak_topic_shares",
    f"""{NUMBERED}, t as (select scan as doc, topic, (scan::bigint * (topic + 3) % 7 + 1)::double as p from (select distinct scan from np), range(3) r(topic)), b as (select topic, kind, (k * 10)::double as value, (k % 5 + topic + 1)::double as p from range(3) t(topic), (values ('frag'), ('loss')) v(kind), range(150) r(k)),
    s as (select scan as doc, peak_idx, 'frag' as kind, frag_mz as at from np union all select scan, peak_idx, 'loss', precmz - frag_mz from np),
    h as (select s.doc, peak_idx, b.topic, sum(t.p * b.p) as s from s join b on s.kind = b.kind and abs(s.at - b.value) <= 0.5e0 + 1e-12 join t on t.doc = s.doc and t.topic = b.topic group by 1, 2, 3)
    select doc, peak_idx, topic::int as topic, {q6('s / sum(s) over (partition by doc, peak_idx)')} as share from h""",
)
def peak_topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    mixes = rows.select("scan").distinct().select(F.col("scan").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("topic"))
    mixes = mixes.withColumn("p", (F.col("doc").cast("bigint") * (F.col("topic") + 3) % 7 + 1).cast("double"))
    features = spark.range(150).select(F.col("id").alias("k"), F.explode(F.array(F.lit("frag"), F.lit("loss"))).alias("kind")).select("k", "kind", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("topic"))
    features = features.select("topic", "kind", (F.col("k") * 10).cast("double").alias("value"), (F.col("k") % 5 + F.col("topic") + 1).cast("double").alias("p"))
    out = topics.shares(rows.select(F.col("scan").alias("doc"), "peak_idx", F.col("frag_mz").alias("mz"), F.col("precmz").alias("precursor")), mixes, features, 0.5)
    return out.select("doc", "peak_idx", "topic", r6("share").alias("share"))


@register(
    "topic_feature_counts_beta",
    f"""{THETA}, n as (select distinct doc, (doc * 31 + k * 17) % 500 as word from (select distinct doc from theta), range(4) r(k))
    select word, count(distinct doc) as docs from n where doc in (select doc from theta where topic = 3 and p between 0.02e0 and 1) and word in (select word from beta where topic = 3 and p between 0.0005e0 and 0.002e0) group by word""",
)
def topic_feature_counts_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    documents = t.select("doc").distinct().select("doc", F.explode(F.array(*[(F.col("doc") * 31 + k * 17) % 500 for k in range(4)])).alias("word"))
    return summaries.feature_counts(documents, t, 3, 0.02, 1.0, beta(spark, sf_dir), (0.0005, 0.002))


CURATED = "select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 1 else 2 end as ms_level, case when o_orderstatus = 'F' then ' Positive' else 'negative' end as ionmode, case when o_custkey % 5 = 0 then '' else 'C' || o_custkey end as smiles from orders"


@register("library_curated", f"with s as ({CURATED}) select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from s where ms_level = 2 and lower(trim(ionmode)) = 'positive' and trim(smiles) <> '') where k = 1")
def library_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.curated(summaries.library_spectra(over(spark, sf_dir, CURATED, "orders")), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@register(
    "row_ledger",
    "with r as (select row_number() over (order by o_orderkey) - 1 as n, o_orderkey::varchar || ':' || o_orderstatus as value from orders) select min(n) as start, max(n) + 1 as \"end\", count(*) as rows, sha256(string_agg(value, chr(10) order by n)) as sha256 from r group by n // 400",
)
def row_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus").alias("value"))
    return summaries.row_ledger(ordered.numbered(rows, "o_orderkey"), 400)


@register("word_features", f"{PEAKS}, w as (select distinct floor(frag_mz) as mz, scan::bigint % 3 as k from ms2) select distinct k::int as kind, case when k = 2 then 0 else {q6('ln(1 + mz) / ln(2001e0)')} end as value, mz from w")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms2_peaks(spark, sf_dir).select(F.floor("frag_mz").cast("double").alias("mz"), (F.col("scan").cast("bigint") % 3).alias("k")).distinct()
    word = F.concat(F.element_at(F.array(F.lit("frag@"), F.lit("LOSS@"), F.lit("other@")), (F.col("k") + 1).cast("int")), F.col("mz").cast("bigint").cast("string"))
    return rows.select(scalars.word_feature(word).alias("f"), "mz").select("f.kind", r6("f.value").alias("value"), "mz").distinct()


@register(
    "corpus_words_losses",
    f"""{PEAKS}, w as (select scan, frag_mz, precmz, round_even(100e0 * (frag_intens / max(frag_intens) over (partition by scan)), 0)::bigint as n from ms2),
    k as (select scan, n, 'frag@' || (floor(frag_mz + 0.5e0))::varchar as word from w union all select scan, n, 'loss@' || (floor(precmz - frag_mz + 0.5e0))::varchar from w where precmz - frag_mz > 0.01e0)
    select scan, word, sum(n)::bigint as n from k where n > 0 group by scan, word""",
)
def corpus_words_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.words(ms2_peaks(spark, sf_dir), 0, losses=True, parts=scan_parts(spark, sf_dir))


@register(
    "group_split",
    """with recursive g as (select o_orderpriority || o_orderstatus || (o_custkey % 4)::varchar as grp, count(*) as n from orders group by 1), o as (select grp, n, row_number() over (order by n desc, sha256('5' || chr(0) || grp)) as k from g), s as (select sum(n) as total from g),
    w as (select total * 0.7e0 as w1, total * 0.15e0 as w2, total * 0.15e0 as w3 from s),
    r as (select 0::bigint as k, 0::double as h1, 0::double as h2, 0::double as h3, ''::varchar as grp, ''::varchar as split
      union all select k, h1 + case split when 'train' then n else 0 end, h2 + case split when 'validation' then n else 0 end, h3 + case split when 'test' then n else 0 end, grp, split from (
        select o.k, o.n, o.grp, h1, h2, h3, list_sort([
          {'a': greatest(h1 + n - w1, 0) / greatest(w1, 1), 'b': -(w1 - h1) / greatest(w1, 1), 'c': sha256('5' || chr(0) || o.grp || chr(0) || 'train'), 'd': 'train'},
          {'a': greatest(h2 + n - w2, 0) / greatest(w2, 1), 'b': -(w2 - h2) / greatest(w2, 1), 'c': sha256('5' || chr(0) || o.grp || chr(0) || 'validation'), 'd': 'validation'},
          {'a': greatest(h3 + n - w3, 0) / greatest(w3, 1), 'b': -(w3 - h3) / greatest(w3, 1), 'c': sha256('5' || chr(0) || o.grp || chr(0) || 'test'), 'd': 'test'}])[1].d as split
        from r join o on o.k = r.k + 1 cross join w))
    select r.grp, split, n from r join o using (grp) where r.k > 0""",
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 4).cast("string")).alias("grp"))
    return metrics.split_by_group(rows, "grp", {"train": 0.7, "validation": 0.15, "test": 0.15}, 5).groupBy("grp", "split").agg(F.count("*").alias("n"))


@register(
    "network_node_sizes",
    f"""with m as (select label as motif, max(vec_id) % 11 / 10e0 as s, count(*) as molecules, max(vec_id) % 9 + 1 as features from embeddings group by label), x as (select *, case when motif % 3 > 0 then s end as score from m)
    select motif, {q6('power(coalesce(score, 0.7e0) * 100, 2) / 2')} as size, {q6('power(coalesce(score, 0.7e0) * 10, 3) / 3 + power(molecules * 1e0 / max(molecules) over () * 10, 3) / 3 + power(features * 1e0 / max(features) over () * 10, 3) / 3')} as size_interactive from x""",
)
def network_node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("motif")).agg((F.max("vec_id") % 11 / 10.0).alias("score"), F.count("*").alias("molecules"), (F.max("vec_id") % 9 + 1).alias("features"))
    return network.node_sizes(rows.withColumn("score", F.when(F.col("motif") % 3 > 0, F.col("score")))).select("motif", r6("size").alias("size"), r6("size_interactive").alias("size_interactive"))


@register("motif_set_pairs", "with p as (select distinct o_custkey % 40 as a, o_orderkey % 30 as b from orders where o_orderstatus = 'F') select count(distinct a) as n_a, count(distinct b) as n_b from p")
def motif_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.set_pairs(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 30).alias("b")))[1]


GRAPH = "select distinct 'm<' || (vec_id % 5) as motif, case when label % 2 = 0 then 'frag_' else 'loss_' end || (vec_id % 13) as feature, (vec_id % 5 % 4) / 4e0 as weight, case when label % 2 = 0 then 'red' else 'blue' end as color from embeddings"


@register(
    "graphml_document",
    f"""with g as ({GRAPH}), l as (select '<node id="' || replace(n, '<', '&lt;') || '"/>' as value from (select motif as n from g union select feature from g)
    union all select '<edge source="' || replace(motif, '<', '&lt;') || '" target="' || feature || '"><data key="weight">' || weight::varchar || '</data><data key="color">' || color || '</data></edge>' from g) select value from l""",
)
def graphml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node and edge lines of the document."""
    return network.graphml_lines(over(spark, sf_dir, GRAPH.replace("4e0", "4D"), "embeddings")).filter("place.part in (1, 2)").select("value")


@register(
    "network_elements",
    f"""{SIDES}, f as (select scan as motif, kind, floor(mz) as mz, (i / 50e0) as p from sd where charge = 1), k as (select motif, kind, kind || '_' || mz::bigint as feature, mz, p from f where p >= 0.9e0),
    e as (select motif as source, feature as target, {q6('max(p)')} as weight from k group by 1, 2), l as (select distinct a.feature as source, b.feature as target from k a join k b on a.motif = b.motif and a.kind = 'loss' and b.kind = 'frag' and abs((2000 - a.mz) - b.mz) <= 5)
    select * from e union all select source, target, null from l""",
)
def network_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif")).select("motif", "kind", F.floor("mz").alias("mz"), (F.col("i") / 50.0).alias("p"))
    return network.elements(rows, 2000.0, 0.9, 5.0)[1].select("source", "target", r6("weight").alias("weight"))


@register("network_feature_edges", f"{SIDES} select scan as motif, kind || '_' || floor(mz)::bigint as feature, {q6('i / 50e0')} as weight, case kind when 'frag' then 'red' else 'blue' end as color from sd where charge = 1 and i / 50e0 >= 0.9e0")
def network_feature_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif")).select("motif", "kind", F.floor("mz").alias("mz"), (F.col("i") / 50.0).alias("p"))
    return network.feature_edges(rows, 0.9).select("motif", "feature", r6("weight").alias("weight"), "color")


@register(
    "comments_remapped",
    f"""{NUMBERED}, c as (select scan, frag_mz + case when peak_idx % 2 = 0 then frag_mz * 5e-6 else 0 end + case when peak_idx % 3 = 0 then 1 else 0 end as mz, peak_idx as place, 'c' || peak_idx as comment from np),
    p as (select distinct scan, frag_mz as now from np), n as (select c.*, max(case when now = mz then now end) over w as same, min(now) over w as first, now from c join p using (scan) where abs(mz - now) <= 1e-8 + 1e-5 * abs(now) window w as (partition by scan, mz, place, comment)),
    m as (select distinct scan, coalesce(same, first) as mz, same is null as late, place, comment from n)
    select scan, {named('mz')}, string_agg(comment, '; ' order by late, place, comment) as comment from m group by scan, mz""",
)
def comments_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    moved = F.col("frag_mz") + F.when(F.col("peak_idx") % 2 == 0, F.col("frag_mz") * 5e-6).otherwise(0) + F.when(F.col("peak_idx") % 3 == 0, 1).otherwise(0)
    comments = rows.select("scan", moved.alias("mz"), F.col("peak_idx").alias("place"), F.concat(F.lit("c"), F.col("peak_idx").cast("string")).alias("comment"))
    return motifs.remapped_comments(comments, rows.select("scan", F.col("frag_mz").alias("mz"))).select("scan", r6("mz").alias("mz"), "comment")


@register(
    "published_topics",
    f"""{SIDES}, m as (select charge as topic, kind, floor(mz + 0.5e0) as mz, i from sd where i > 0), v as (select distinct kind, floor(mz + 0.5e0) as mz from sd where charge = 2)
    select count(distinct topic) as topics, count(*) filter (v.mz is not null) as retained, count(*) filter (v.mz is null) as omitted, 0::bigint as empty from m left join v using (kind, mz)""",
)
def published_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir), "charge").withColumnRenamed("charge", "topic")
    known = rows.filter("topic = 2").select(F.concat("kind", F.lit("@"), scalars.round_mz("mz", 0).cast("string")).alias("word"))
    return motifs.published_beta(rows, known, 0)[1].select("topics", F.col("retained").cast("bigint").alias("retained"), F.col("omitted").cast("bigint").alias("omitted"), "empty")


@register(
    "previous_ms1",
    "select file, n, last_value(case when lvl = 1 then scan end ignore nulls) over (partition by file order by n) as ms1scan from (select o_custkey as file, o_orderkey as n, case when o_orderstatus = 'F' then 1 else 2 end as lvl, 's' || o_orderkey as scan from orders)",
)
def previous_ms1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("ms_level"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("scan"))
    return peaks.previous_ms1(rows).select("file", "n", "ms1scan")


@register(
    "unique_molecule_hits",
    """with h as (select l_orderkey as query, l_partkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice)::int as rank from lineitem), n as (select h.*, p_brand as molecule from h join part on id = p_partkey),
    f as (select * from (select *, row_number() over (partition by query, molecule order by rank) as nth from n) where nth = 1) select query, id, molecule, place::int as place from (select *, row_number() over (partition by query order by rank) as place from f) where place <= 2""",
)
def unique_molecule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("id"), rank.alias("rank"))
    molecules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("molecule"))
    return similarity.unique_hits(hits, molecules, 2).select("query", "id", "molecule", "place")


@register(
    "motif_optimised",
    f"""{SIDES}, h as (select distinct ms1 as motif, scan as hit, kind, floor(mz / 300e0 + 0.5e0) as feature from (select sd.*, ms1scan as ms1 from sd join (select distinct scan, ms1scan from ms2) using (scan))), c as (select motif, kind, count(distinct hit) as hits from h group by 1, 2),
    s as (select motif, kind, feature from (select motif, kind, feature, count(*) as n from h group by 1, 2, 3) join c using (motif, kind) where n = hits)
    select k.motif, k.kind, {q6('k.mz')} as mz from (select ms1scan as motif, kind, mz from sd join (select distinct scan, ms1scan from ms2) using (scan)) k where exists (select 1 from s where s.motif = k.motif and s.kind = k.kind and s.feature = floor(k.mz / 300e0 + 0.5e0))""",
)
def motif_optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(numbered(spark, sf_dir), "scan", F.col("ms1scan").alias("motif")).withColumn("scaled", F.col("mz") / 300.0)
    hits = rows.select("motif", F.col("scan").alias("hit"), "kind", F.col("scaled").alias("mz"))
    own = rows.select("motif", "kind", F.col("scaled").alias("mz"), "i", F.col("mz").alias("true"))
    return screening.optimised(own, hits, 0).select("motif", "kind", r6("true").alias("mz"))


@register(
    "same_float_peaks",
    f"""{NUMBERED}, a as (select scan, (frag_mz::float)::double as f, peak_idx as x, count(*) over (partition by scan, frag_mz::float) as n from np), b as (select scan, f, x + 100 as y, n from a where x % 2 = 0)
    select a.scan, x, y::int as y from a join (select *, count(*) over (partition by scan, f) as m from b) b using (scan, f) where a.n = 1 and m = 1""",
)
def same_float_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir).select("scan", F.col("frag_mz").alias("mz"), F.col("peak_idx").alias("x"))
    other = rows.filter("x % 2 = 0").select("scan", F.col("mz").cast("float").cast("double").alias("mz"), (F.col("x") + 100).alias("y"))
    return screening.same_float(rows, other, ["scan"]).select("scan", "x", "y")


@register(
    "call_latencies",
    f"select o_orderpriority as arm, {q6('quantile_cont(s, 0.5)')} as median, {q6('quantile_cont(s, 0.95)')} as p95, {q6('sum(n) / sum(s)')} as per_second from (select o_orderpriority, floor(o_totalprice)::double as s, o_custkey * 1e0 as n from orders) group by 1",
)
def call_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.floor("o_totalprice").cast("double").alias("seconds"), (F.col("o_custkey") * 1.0).alias("items"))
    return summaries.latencies(rows, "arm").select("arm", *(r6(c).alias(c) for c in ("median", "p95", "per_second")))


@register("array_violations", f"{PEAKS}, g as (select ms1scan as key, list(frag_mz - 200) as mz from ms2 where charge = 1 group by ms1scan) select 0::bigint as repeated, 0::bigint as unequal, 0::bigint as not_finite, count(*) filter (len(list_filter(mz, lambda x: x <= 0)) > 0) as not_positive from g")
def array_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms2_peaks(spark, sf_dir).filter("charge = 1").groupBy(F.col("ms1scan").alias("key")).agg(F.collect_list(F.col("frag_mz") - 200).alias("mz"), F.collect_list("frag_mz").alias("values"))
    return summaries.violations(rows, "key")


def digamma_sql(x: str) -> str:
    """Six steps of the recurrence, then the asymptotic series."""
    y = f"({x} + 6)"
    r = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5e0 / {y} - {r} * (1 / 12e0 - {r} * (1 / 120e0 - {r} * (1 / 252e0 - {r} / 240e0))) - " + " - ".join(f"1 / ({x} + {k})" for k in range(6)) + ")"


#: Topic k gives word w the weight 1 + (7 w + 3 k) % 5; documents are scans, words are hundreds of m/z.
LDA_WORDS, LDA_TOPICS = 60, 3
LDA_SQL = f"""{PEAKS}, n as (select scan as doc, floor(frag_mz / 100e0)::int as w, count(*)::double as n from ms2 where frag_mz < {LDA_WORDS * 100} group by 1, 2), l as (select k, w, (1 + (w * 7 + k * 3) % 5)::double as lam from range({LDA_TOPICS}) a(k), range({LDA_WORDS}) b(w)),
    b as (select k, w, {digamma_sql('lam')} - {digamma_sql('(sum(lam) over (partition by k))')} as eb from l), d as (select doc, sum(n) as total from n group by doc),
    s as (select n.doc, n.w, k, n.n, exp(eb) as e from n join b using (w)), phi as (select doc, w, k, n * e / sum(e) over (partition by doc, w) as c from s)"""


def fixed_topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lda.TopicModel]:
    import numpy as np

    w, k = np.arange(LDA_WORDS), np.arange(LDA_TOPICS)[:, None]
    model = lda.TopicModel((1 + (w * 7 + k * 3) % 5).astype(float), np.full(LDA_TOPICS, 0.1), [str(x) for x in w])
    cells = ms2_peaks(spark, sf_dir).filter(F.col("frag_mz") < LDA_WORDS * 100).groupBy(F.col("scan").alias("doc"), F.floor(F.col("frag_mz") / 100.0).cast("int").alias("id")).agg(F.count("*").alias("n"))
    listed = cells.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("c"))
    return listed.select("doc", F.col("c.id").alias("ids"), F.col("c.n").alias("counts")), model


@register("lda_expectation", f"{LDA_SQL}, g as (select doc, k, 0.1e0 + sum(c) as g from phi group by 1, 2) select doc, k::int as topic, {q6('g / sum(g) over (partition by doc)')} as p from g")
def lda_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures after one step under given topics; the even start gives every topic one expected log share, which cancels."""
    docs, model = fixed_topics(spark, sf_dir)
    return lda.infer(docs, model, steps=1).select("doc", "topic", r6("p").alias("p"))


@register("lda_maximisation", f"{LDA_SQL}, t as (select k, w, sum(c) as c from phi group by 1, 2) select k::int as topic, w::varchar as word, {q6('(0.01e0 + coalesce(c, 0)) / sum(0.01e0 + coalesce(c, 0)) over (partition by k)')} as p from l left join t using (k, w)")
def lda_maximisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic-word table after one round over all documents from given topics."""
    docs, model = fixed_topics(spark, sf_dir)
    return lda.table(spark, lda.fit(docs, model.words, LDA_TOPICS, epochs=1, steps=1, start=model)).select("topic", "word", r6("p").alias("p"))


def fixed_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, topic_table.TopicTable]:
    """The same documents as cells and the same topics as rows by word."""
    docs, model = fixed_topics(spark, sf_dir)
    rows = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(model.lam.T)], "id bigint, v array<double>")
    cells = docs.select("doc", F.inline(F.arrays_zip("ids", "counts"))).toDF("doc", "id", "n")
    return cells, topic_table.given(rows, len(model.words), model.alpha)


@register("topic_table_expectation", f"{LDA_SQL}, g as (select doc, k, 0.1e0 + sum(c) as g from phi group by 1, 2) select doc, k::int as topic, {q6('g / sum(g) over (partition by doc)')} as p from g")
def topic_table_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lda_expectation's mixtures where the topic-word table is partitioned by word."""
    return topic_table.infer(*fixed_table(spark, sf_dir), steps=1).select("doc", "topic", r6("p").alias("p"))


@register("topic_table_maximisation", f"{LDA_SQL}, t as (select k, w, sum(c) as c from phi group by 1, 2) select k::int as topic, w::varchar as word, {q6('(0.01e0 + coalesce(c, 0)) / sum(0.01e0 + coalesce(c, 0)) over (partition by k)')} as p from l left join t using (k, w)")
def topic_table_maximisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lda_maximisation's table where it is partitioned by word."""
    cells, model = fixed_table(spark, sf_dir)
    words = spark.range(model.vocabulary).select("id", F.col("id").cast("string").alias("word"))
    return topic_table.table(topic_table.fit(cells, model, epochs=1, steps=1), words).select("topic", "word", r6("p").alias("p"))


@register("lda_responsibilities", f"{LDA_SQL} select doc, w::int as word, k::int as topic, {q6('c / n')} as p from (select phi.*, n.n from phi join n using (doc, w)) where c / n >= 0.2e0")
def lda_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = fixed_topics(spark, sf_dir)
    return lda.responsibilities(docs, model, steps=1, least=0.2).select("doc", F.col("id").alias("word"), "topic", r6("p").alias("p"))


@register(
    "motif_store_rows",
    f"{SIDES} select scan as motif_id, count(*)::int as n, count(*) filter (kind = 'frag')::int as fragments, {q6('sum(mz)')} as total from sd where charge = 1 group by scan",
)
def motif_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs as rows of arrays, and back."""
    rows = sides(numbered(spark, sf_dir).filter("charge = 1"), F.col("scan").alias("motif_id"), "motifset", "peak_idx")
    ms2 = motifs.motif_tables(rows)[1].withColumn("annotation", F.lit(None).cast("string"))
    again = readers.exploded_motifs(readers.grouped_motifs(ms2))
    return again.groupBy("motif_id").agg(F.count("*").cast("int").alias("n"), F.count("frag_mz").cast("int").alias("fragments"), r6(F.sum(F.coalesce("frag_mz", "loss_mz"))).alias("total"))


@register(
    "extracted_scans",
    f"{PEAKS}, w as (select distinct 'f' as file, scan from ms2 where frag_mz > 900), n as (select scan, row_number() over (order by scan::bigint, scan) as new_scan from w) select scan, new_scan::int as new_scan, count(*)::int as peaks, {q6('min(frag_mz)')} as low from n join ms2 using (scan) where new_scan <= 50 group by 1, 2",
)
def extracted_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms2_peaks(spark, sf_dir).withColumn("file", F.lit("f"))
    out = sinks.extracted(rows, rows.filter("frag_mz > 900").select("file", "scan"), 50)
    return out.select("scan", "new_scan", F.size("peaks").alias("peaks"), r6(F.col("peaks")[0]["mz"]).alias("low"))


@register(
    "mean_embeddings",
    f"""{PEAKS}, c as (select scan as doc, floor(frag_mz)::bigint % 700 as word, count(*) as n from ms2 group by 1, 2), e as (select vec_id as word, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings),
    m as (select doc, pos, sum(sqrt(n::double) * x) / sum(sqrt(n::double)) as v from c join e using (word) group by 1, 2) select doc, {q6('sum(v)')} as total, {q6('sqrt(sum(v * v))')} as norm, {q6('max(v) filter (pos = 63)')} as last from m group by doc""",
)
def mean_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ms2_peaks(spark, sf_dir).groupBy(F.col("scan").alias("doc"), (F.floor("frag_mz") % 700).alias("word")).agg(F.count("*").alias("n"))
    words = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("v"))
    means = similarity.mean_embedding(cells, words)
    return means.groupBy("doc").agg(r6(F.sum("value")).alias("total"), r6(F.sqrt(F.sum(F.col("value") * F.col("value")))).alias("norm"), r6(F.max(F.when(F.col("pos") == 63, F.col("value")))).alias("last"))


@register(
    "greedy_cosine_pairs",
    f"""{PEAKS}, p as (select scan, charge, frag_mz as mz, frag_intens as i, row_number() over (partition by scan order by frag_mz, frag_intens) as k from ms2), norms as (select scan, sqrt(sum(i * i)) as norm from p group by scan),
    wide as (select *, unnest([floor(mz / 0.2e0)::bigint - 1, floor(mz / 0.2e0)::bigint, floor(mz / 0.2e0)::bigint + 1]) as bin from p where charge = 2),
    m as (select a.scan as a, b.scan as b, a.k as i, b.k as j, a.i * b.i as product from (select *, floor(mz / 0.2e0)::bigint as bin from p where charge = 1) a join wide b using (bin) where abs(a.mz - b.mz) <= 0.1e0),
    l as (select a, b, list({{'total': product, 'n': 1, 'i': [i], 'j': [j]}} order by product desc, i, j) as found from m group by a, b),
    s as (select a, b, list_reduce(found, lambda done, x: case when list_has_any(done.i, x.i) or list_has_any(done.j, x.j) then done
      else {{'total': done.total + x.total, 'n': done.n + x.n, 'i': list_concat(done.i, x.i), 'j': list_concat(done.j, x.j)}} end) as g from l)
    select a, b, {q6('g.total / (x.norm * y.norm)')} as score, g.n::int as n from s join norms x on x.scan = a join norms y on y.scan = b where g.total / (x.norm * y.norm) >= 0.6e0""",
)
def greedy_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a singly and a doubly charged spectrum whose greedy cosine is at least 0.6."""
    spectra = ms2_peaks(spark, sf_dir, keyed=True).select("_key", "scan", "charge", F.col("frag_mz").alias("mz"), F.col("frag_intens").alias("i"))
    side = lambda charge, name: spectra.filter(F.col("charge") == charge).select("_key", F.col("scan").alias(name), "mz", "i")
    return screening.greedy_search(side(1, "a"), side(2, "b"), 0.6).select("a", "b", r6("score").alias("score"), "n")


@register("lda_gamma", f"{LDA_SQL} select doc, k::int as topic, {q6('0.1e0 + sum(c)')} as gamma from phi group by 1, 2")
def lda_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = fixed_topics(spark, sf_dir)
    return lda.gammas(docs, model, steps=1).select("doc", "topic", r6("gamma").alias("gamma"))


STORE_QUERY = "QUERY scannum(MS2DATA) WHERE MS2PROD=500:TOLERANCEMZ=0.5"


@register(
    "screen_store",
    f"""{PEAKS}, c as (select scan, charge, motifset, short_annotation, 'frag@' || floor(frag_mz + 0.5e0)::bigint as word, sum(frag_intens) as w from ms2 group by all),
    e as (select 'frag@' || vec_id as word, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings),
    m as (select scan, charge, pos, sum(sqrt(w) * x) / sum(sqrt(w)) as v from c join e using (word) group by 1, 2, 3), n as (select scan, charge, pos, v / sqrt(sum(v * v) over (partition by scan)) as v from m),
    k as (select distinct scan, motif_id, motifset, short_annotation from ms2 where charge = 1 and scan in (select scan from ms2 where frag_mz > 499.5e0 and frag_mz < 500.5e0)),
    s as (select a.scan as hit_id, b.scan as ref, sum(a.v * b.v) as score from n a join n b using (pos) where a.charge = 2 and b.scan in (select scan from k) group by 1, 2)
    select hit_id, 'spectrum-motif' as screen_type, k.motif_id as ref_motif_id, k.motifset as ref_motifset, k.short_annotation as ref_short_annotation, count(*) over (partition by hit_id) as hits from s join k on ref = k.scan where score >= 0.6e0""",
)
def screen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubly charged spectra beside the singly charged ones, taken as motifs, that a query finds."""
    spectra = ms2_peaks(spark, sf_dir).drop("loss_mz", "loss_intens")
    words = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("frag@"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("v"))
    found = annotation.screen_store((None, spectra.filter("charge = 1")), STORE_QUERY, words, spectra.filter("charge = 2"), least=0.6, digits=0)
    return found.select("hit_id", "screen_type", "ref_motif_id", "ref_motifset", "ref_short_annotation").withColumn("hits", F.count("*").over(Window.partitionBy("hit_id")))


@register(
    "lineage_faults",
    """with o as (select o_orderkey as key, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as source, o_orderpriority as priority, o_orderstatus as status, year(o_orderdate) as iterations from orders),
    p as (select a.*, b.priority as bp, b.status as bs, b.iterations as bi from o a join o b on a.source = b.key),
    f as (select key, unnest(list_filter([case when status <> bs then 'changes status' end, case when priority <> bp and priority = '1-URGENT' then 'changes priority' end, case when iterations = bi and priority <> '1-URGENT' then 'keeps iterations' end,
      case when iterations <> bi and iterations < bi and priority <> '1-URGENT' then 'does not raise iterations' end, case when iterations <> bi and priority = '1-URGENT' then 'changes iterations' end], lambda x: x is not null)) as fault from p)
    select key, fault from f""",
)
def lineage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, each derived from its customer's one before: urgent ones must keep their options, others must raise the year."""
    orders = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    options = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus", F.lit("iterations"), F.year("o_orderdate").cast("string"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "frozen").otherwise("later")
    frame = orders.select(F.col("o_orderkey").alias("key"), before.alias("source"), kind.alias("kind"), F.lit("next").alias("reason"), options.alias("options"))
    rules = {"frozen": runs.Rule(frozenset()), "later": runs.Rule(frozenset({"priority", "iterations"}), frozenset({"iterations"}), frozenset({"iterations"}))}
    return runs.lineage_faults(frame, rules)


@register(
    "scalar_functions",
    """select o_orderkey as key, round_even(o_totalprice::double / 1e5 * 100, 0)::bigint as times, case when length(o_orderpriority) > 6 then o_orderpriority[1:6] || '...' else o_orderpriority end as short,
    sha256('7' || chr(0) || o_orderkey::varchar) as digest, nullif(regexp_extract('motif_' || o_orderkey, '([0-9]+)', 1), '')::bigint as number, lower(trim(' ' || o_orderstatus || '  ')) as name, o_orderstatus || ', ' || o_orderpriority as list,
    case when o_custkey % 10 = 0 then null when o_custkey % 10 / 10e0 > 0.8e0 then 'high' when o_custkey % 10 / 10e0 > 0.6e0 then 'intermediate' else 'low' end as quality from orders""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 10 / F.lit(10.0))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        scalars.repetitions(F.col("o_totalprice").cast("double") / 1e5).alias("times"),
        scalars.shortened(F.col("o_orderpriority"), 6).alias("short"),
        scalars.stable_digest(7, F.col("o_orderkey").cast("string")).alias("digest"),
        scalars.natural_number(F.concat(F.lit("motif_"), F.col("o_orderkey").cast("string"))).alias("number"),
        scalars.normal_key(F.concat(F.lit(" "), "o_orderstatus", F.lit("  "))).alias("name"),
        scalars.listed(F.array("o_orderstatus", "o_orderpriority")).alias("list"),
        scalars.quality_bin(share).alias("quality"),
    )


LDA_ROUND = f"""{LDA_SQL}, g as (select doc, k, 0.1e0 + sum(c) as g from phi group by 1, 2), t as (select doc, k, g, {digamma_sql('g')} - {digamma_sql('(sum(g) over (partition by doc))')} as lt, g / sum(g) over (partition by doc) as share from g),
    x as (select n.doc, n.w, n.n, sum(exp(t.lt) * exp(b.eb)) as p from n join t on t.doc = n.doc join b on b.w = n.w and b.k = t.k group by 1, 2, 3)"""


@register("lda_evidence", f"{LDA_ROUND}, tokens as (select doc, sum(n * ln(p)) as s from x group by 1) select doc, {q6('max(s) + lgamma(0.3e0) - 3 * lgamma(0.1e0) - lgamma(sum(g)) + sum(lgamma(g)) + sum((0.1e0 - g) * lt)')} as bound from t join tokens using (doc) group by doc")
def lda_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's evidence lower bound under given topics, after one step."""
    docs, model = fixed_topics(spark, sf_dir)
    return lda.evidence(docs, model, steps=1).select("doc", r6("bound").alias("bound"))


LDA_SERIES = """, m as (select l.k, l.w, 0.01e0 + coalesce(c, 0) as v from l left join (select k, w, sum(c) as c from phi group by 1, 2) using (k, w)), beta as (select k, v / sum(v) over (partition by k) as p from m),
    noted as (select (select sum(n * ln(p)) / sum(n) from x) as log_likelihood, (select avg(e) from (select -sum(share * ln(share)) as e from t group by doc)) as entropy_doc, (select avg(e) from (select -sum(p * ln(p)) as e from beta group by k)) as entropy_topic)
    select metric, floor(value * 1e6 + 0.5e0) / 1e6 as value from (select unnest([{'m': 'log_likelihood', 'v': log_likelihood}, {'m': 'perplexity', 'v': exp(-log_likelihood)}, {'m': 'entropy_doc', 'v': entropy_doc}, {'m': 'entropy_topic', 'v': entropy_topic}], recursive := true) from noted) u(metric, value)"""


@register("lda_series", LDA_ROUND + LDA_SERIES)
def lda_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a round of training notes down, where every worker holds the topics."""
    docs, model = fixed_topics(spark, sf_dir)
    checks = lda.fit(docs, model.words, LDA_TOPICS, epochs=1, steps=1, start=model).checks[-1]
    return spark.createDataFrame(sorted(checks.items()), "metric string, value double").select("metric", r6("value").alias("value"))


@register("topic_table_series", LDA_ROUND + LDA_SERIES)
def topic_table_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where the topics are a partitioned table."""
    checks = topic_table.fit(*fixed_table(spark, sf_dir), epochs=1, steps=1).checks[-1]
    rows = spark.createDataFrame(sorted(checks.items()), "metric string, value double").filter(~F.col("metric").isin("table", "prior"))
    return rows.select("metric", r6("value").alias("value"))


@register(
    "consensus_containment",
    f"with f as (select vec_id, label, {POSITIONS.format('0')} as s from embeddings), b as (select label, pos from (select label, unnest(range(64)) as pos, (unnest(embedding) > 0)::int as b from embeddings) group by label, pos having avg(b) >= 0.5e0), c as (select label, list(pos) as m from b group by label) select vec_id, {q6('coalesce(len(list_intersect(m, s)) * 1e0 / len(m), 0)')} as score from f left join c using (label)",
)
def consensus_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of its label's consensus fingerprint each vector has."""
    rows = table(spark, sf_dir, "embeddings")
    bits = similarity.consensus(rows.select("label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits")), "label", 0.5).filter("bit = 1")
    motif = bits.groupBy("label").agg(F.collect_list("pos").alias("m"))  # 64 positions
    mine = rows.select("vec_id", "label", positions(0).alias("s")).join(motif, "label", "left")
    return mine.select("vec_id", r6(F.coalesce(similarity.containment(F.col("m"), F.col("s")), F.lit(0.0))).alias("score"))


@register("wide_scores", f"select vec_id // 5 as id, {', '.join(f'{q6(f"max(embedding[1]::double) filter (vec_id % 5 = {k})")} as q{k}' for k in range(5))} from embeddings group by 1")
def wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("q"), (F.col("vec_id") % 5).cast("string")).alias("query"), F.floor(F.col("vec_id") / 5).alias("id"), r6(F.col("embedding")[0].cast("double")).alias("score"))
    return annotation.wide_scores(scores, [f"q{k}" for k in range(5)])


CLUSTERS = "with c as (select o_custkey::varchar as motif, row_number() over (partition by o_custkey order by o_orderkey)::int as rank, (o_orderkey * 7 % 3)::int as cluster from orders)"


@register(
    "selected_hits",
    f"{CLUSTERS}, b as (select motif, cluster, count(*) as n, min(rank) as first from c group by 1, 2), w as (select motif, arg_min(cluster, first) as best, arg_min(cluster, (-n, first)) as biggest from b group by 1) select motif, rank, cluster, cluster = best as in_best, cluster = biggest as in_biggest from c join w using (motif)",
)
def selected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the hits of a motif, in clusters: which are in the first one's, which in the largest."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("motif"), place.alias("rank"), (F.col("o_orderkey") * 7 % 3).cast("int").alias("cluster"))
    out = rows
    for how in ("best", "biggest"):
        kept = screening.selected_hits(rows, how).select("motif", "rank", F.lit(True).alias(f"in_{how}"))
        out = out.join(kept, ["motif", "rank"], "left").withColumn(f"in_{how}", F.coalesce(f"in_{how}", F.lit(False)))
    return out


@register("bit_vectors", "select vec_id, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bits from embeddings")
def bit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(annotation.bit_vector(positions(0), 64).cast("array<string>"), "").alias("bits"))


@register("natural_order", "select name, row_number() over (order by n, name)::int as place from (select distinct 'motif_' || o_custkey as name, o_custkey as n from orders)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names such as motif_12 by the number inside them."""
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("motif_"), F.col("o_custkey").cast("string")).alias("name")).distinct()
    return ordered.numbered(names.withColumn("n", scalars.natural_number(F.col("name"))), "n", "name", name="place").select("name", (F.col("place") + 1).cast("int").alias("place"))


@register("common_order", "select o_custkey as item, count(*) as n, row_number() over (order by count(*) desc, o_custkey)::int as place from orders group by 1")
def common_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common items first."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n"))
    return ordered.numbered(counts, F.desc("n"), "item", name="place").withColumn("place", (F.col("place") + 1).cast("int"))


@register(
    "reference_library",
    f"""{PEAKS}, w as (select scan, frag_mz, frag_intens, frag_intens / max(frag_intens) over (partition by scan) as w from ms2), k as (select *, count(*) over (partition by scan) as peaks from w where frag_mz <= 700 and w >= 0.2e0),
    n as (select scan as doc, 'frag@' || floor(frag_mz + 0.5e0)::bigint as word, round_even(100e0 * (frag_intens / top), 0) as n from (select *, max(frag_intens) over (partition by scan) as top from k where peaks >= 2)), c as (select doc, word, sum(n) / 100e0 as w from n where n > 0 group by 1, 2),
    e as (select 'frag@' || vec_id as word, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings), m as (select doc, pos, sum(sqrt(w) * x) / sum(sqrt(w)) as v from c join e using (word) group by 1, 2)
    select doc, {q6('sum(v)')} as total, {q6('sqrt(sum(v * v))')} as norm from m group by doc""",
)
def reference_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned spectra as the vectors of a library."""
    words = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("frag@"), F.col("vec_id").cast("double").cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("v"))
    library = annotation.reference_library(ms2_peaks(spark, sf_dir), words, 0, low_mz=0.0, high_mz=700.0, low=0.2, least=2)
    add = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    return library.select("doc", r6(add(lambda x: x)).alias("total"), r6(F.sqrt(add(lambda x: x * x))).alias("norm"))
