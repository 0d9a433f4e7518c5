"""The registered queries of the library, each beside SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sketches
from .operators import lda, metrics, network, peaks, screening, similarity, summaries, topics
from .plans import drawing
from .plans.compiler import run, run_many
from .operators.shared import settle
from .registry import ORACLES, PEAKS, QUERIES, THETA, named, q6, r6, register
from .sources.adapters import WORDS_SQL, beta, ms1_peaks, ms2_peaks, scan_parts, theta

FLAGSHIP = "QUERY scaninfo(MS2DATA) WHERE MS2PROD=178.03:TOLERANCEMZ=0.5"


def peak_query(name: str, query: str, columns: list[str] | None, sql: str, ms1: bool = False) -> None:
    """Register a query of the peak language; columns: what is compared."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_many(query, ms1_peaks(spark, sf_dir) if ms1 else None, ms2_peaks(spark, sf_dir)) if "|||" in query else run(query, ms1_peaks(spark, sf_dir) if ms1 else None, ms2_peaks(spark, sf_dir))
        return out.selectExpr(*columns) if columns else out

    QUERIES[name] = f
    ORACLES[name] = f"{PEAKS} {sql}"


def band(mz: str, at: str, tol: str = "0.1e0") -> str:
    return f"{mz} > {at} - {tol} and {mz} < {at} + {tol}"


INFO = ["scan", "ms1scan", named("precmz"), "charge", "motif_id", "motifset", "mslevel", named("i")]
INFO_SQL = f"select scan, max(ms1scan) as ms1scan, {q6('max(precmz)')} as precmz, max(charge) as charge, max(motif_id) as motif_id, max(motifset) as motifset, 2 as mslevel, {q6('sum(frag_intens)')} as i from ms2"
HIT = band("frag_mz", "178.03e0", "0.5e0")

peak_query("ql_scaninfo_ms2prod", FLAGSHIP, INFO, f"{INFO_SQL} where scan in (select scan from ms2 where {HIT}) group by scan")
peak_query(
    "ql_scannum_nl_excluded",
    "QUERY scannum(MS2DATA) WHERE MS2NL=505:TOLERANCEMZ=5 AND MS2PROD=200:TOLERANCEMZ=100:EXCLUDED",
    None,
    f"select distinct scan from ms2 where scan in (select scan from ms2 where {band('loss_mz', '505', '5')}) and scan not in (select scan from ms2 where {band('frag_mz', '200', '100')})",
)
peak_query(
    "ql_cardinality_or",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=(100 OR 200 OR 400):TOLERANCEMZ=20:CARDINALITY=range(min=2,max=3)",
    None,
    f"select scan from (select scan, max(({band('frag_mz', '100', '20')})::int) + max(({band('frag_mz', '200', '20')})::int) + max(({band('frag_mz', '400', '20')})::int) as n from ms2 group by scan) where n between 2 and 3",
)
peak_query(
    "ql_massdefect_any",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=ANY:MASSDEFECT=massdefect(min=0.2,max=0.25) AND POLARITY=Positive",
    None,
    "select distinct scan from ms2 where polarity = 1 and frag_mz - floor(frag_mz) > 0.2e0 and frag_mz - floor(frag_mz) < 0.25e0",
)
peak_query("ql_metafilter", FLAGSHIP + " METAFILTER:motifset=BUILDING", INFO, f"{INFO_SQL} where motifset = 'BUILDING' and scan in (select scan from ms2 where {HIT}) group by scan")
for _name, _agg in (("scansum", "sum"), ("scanmaxint", "max"), ("scanrangesum", "sum")):
    peak_query(
        f"ql_{_name}",
        f"QUERY {_name}(MS2DATA) WHERE MS2PREC=1500:TOLERANCEMZ=50",
        ["scan", named("frag_intens")],
        f"select scan, {q6(f'{_agg}(frag_intens)')} as frag_intens from ms2 where {band('precmz', '1500', '50')} group by scan",
    )
peak_query(
    "ql_scanrangesum_ms1",
    "QUERY scanrangesum(MS1DATA) WHERE RTMIN=1 AND RTMAX=5",
    ["bin", "scan", named("i_sum")],
    f"select floor(mz / 0.1e0)::bigint as bin, scan, {q6('sum(i)')} as i_sum from ms1 where rt > 1 and rt < 5 group by 1, 2",
    ms1=True,
)
peak_query(
    "ql_scanmz_subquery",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=(QUERY scanmz(MS2DATA) WHERE MS2PREC=300:TOLERANCEMZ=2):TOLERANCEMZ=0.01",
    None,
    f"select distinct p.scan from ms2 p join (select distinct precmz from ms2 where {band('precmz', '300', '2')}) t on p.frag_mz > t.precmz - 0.01e0 and p.frag_mz < t.precmz + 0.01e0",
)
peak_query(
    "ql_ms1_link",
    "QUERY scaninfo(MS1DATA) WHERE MS1MZ=2050:TOLERANCEMZ=50:INTENSITYPERCENT=50",
    ["scan", "mslevel", named("i"), named("i_norm")],
    f"select scan, 1 as mslevel, {q6('sum(i)')} as i, {q6('max(i_norm)')} as i_norm from ms1 where scan in (select scan from ms1 where {band('mz', '2050', '50')} and i_norm > 0.5e0) group by scan",
    ms1=True,
)
peak_query(
    "ql_intensity_match",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=300:TOLERANCEMZ=100:INTENSITYMATCH=Y:INTENSITYMATCHREFERENCE AND MS2PROD=600:TOLERANCEMZ=150:INTENSITYMATCH=Y*1.5:INTENSITYMATCHPERCENT=40",
    None,
    f"select scan from (select scan, sum(frag_intens) filter ({band('frag_mz', '300', '100')}) as ref, sum(frag_intens) filter ({band('frag_mz', '600', '150')}) as s from ms2 group by scan) where s > ref * 1.5e0 * (1 - 0.4e0) and s < ref * 1.5e0 * (1 + 0.4e0)",
)
peak_query(
    "ql_otherscan",
    "QUERY scannum(MS1DATA) WHERE MS1MZ=3990:TOLERANCEMZ=20:OTHERSCAN=rtrange(left=0.05,right=0.05)",
    None,
    f"select distinct a.scan from ms1 a join (select distinct rt from ms1 where {band('mz', '3990', '20')}) b on b.rt > a.rt - 0.05e0 and b.rt < a.rt + 0.05e0",
    ms1=True,
)
peak_query(
    "ql_filter_peaks",
    "QUERY MS2DATA WHERE MS2PREC=1500:TOLERANCEMZ=50 FILTER MS2PROD=(300 OR 500):TOLERANCEMZ=40",
    ["scan", named("frag_mz"), named("frag_intens")],
    f"select scan, {q6('frag_mz')} as frag_mz, {q6('frag_intens')} as frag_intens from ms2 where {band('precmz', '1500', '50')} and ({band('frag_mz', '300', '40')} or {band('frag_mz', '500', '40')})",
)
peak_query(
    "ql_scan_charge_range",
    "QUERY scannum(MS2DATA) WHERE SCANMIN=100 AND SCANMAX=5000 AND CHARGE=2 AND MS2NL=ANY:MASSDEFECT=massdefect(min=0.5,max=0.6)",
    None,
    "select distinct scan from ms2 where cast(scan as bigint) between 100 and 5000 and charge = 2 and loss_mz - floor(loss_mz) > 0.5e0 and loss_mz - floor(loss_mz) < 0.6e0",
)
peak_query(
    "ql_formula_ppm",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=formula(C10H16N5O13P3):TOLERANCEPPM=500",
    None,
    f"select distinct scan from ms2 where {band('frag_mz', '506.99574513e0', '506.99574513e0 * 500 / 1e6')}",
)
peak_query(
    "ql_many",
    "QUERY scannum(MS2DATA) WHERE MS2PROD=178.03:TOLERANCEMZ=0.5 ||| QUERY scannum(MS2DATA) WHERE MS2PROD=500:TOLERANCEMZ=0.5",
    None,
    f"select distinct scan, 0 as query_index from ms2 where {HIT} union all select distinct scan, 1 from ms2 where {band('frag_mz', '500', '0.5e0')}",
)


XS = """xs as (select distinct frag_mz as x from ms2 where {where}), g as (select min(x) as x from xs union all select (select min(xs.x) from xs where xs.x >= g.x + 0.05e0) from g where g.x is not null), c as (select x from g where x is not null)"""


def variable_query(name: str, query: str, where: str, pairs: str) -> None:
    """Register a query with the variable X: candidates are thinned greedily, and of a scan's candidates with one whole part the least stays."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(query, None, ms2_peaks(spark, sf_dir)).select("scan", "comment", r6("i").alias("i"))

    QUERIES[name] = f
    ORACLES[name] = f"{PEAKS.replace('with ms2', 'with recursive ms2', 1)}, {XS.format(where=where)}, pairs as ({pairs}), f as (select scan, min(x) as x from pairs group by scan, floor(x)) select f.scan, f.x as comment, {q6('sum(frag_intens)')} as i from f join ms2 using (scan) group by 1, 2"


variable_query(
    "ql_variable",
    "QUERY scaninfo(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1 AND MS2PROD=X+100:TOLERANCEMZ=0.1 AND X=range(min=200,max=300)",
    "frag_mz between 200 and 300",
    f"select distinct a.scan, c.x from c join ms2 a on {band('a.frag_mz', 'c.x')} join ms2 b on b.scan = a.scan and {band('b.frag_mz', '(c.x + 100)')}",
)
variable_query(
    "ql_variable_massdefect",
    "QUERY scaninfo(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1 AND MS2NL=2*(X-100)+50:TOLERANCEMZ=1 AND X=massdefect(min=0.2,max=0.21)",
    "frag_mz - floor(frag_mz) between 0.2e0 and 0.21e0",
    f"select distinct a.scan, c.x from c join ms2 a on {band('a.frag_mz', 'c.x')} join ms2 b on b.scan = a.scan and {band('b.loss_mz', '(2e0 * (c.x - 100) + 50)', '1e0')}",
)
peak_query("ql_ms1_of_ms2", "QUERY scannum(MS1DATA) WHERE MS2PROD=178.03:TOLERANCEMZ=0.5", None, f"select distinct scan from ms1 where scan in (select ms1scan from ms2 where {HIT})", ms1=True)
peak_query("ql_ms2_of_ms1", "query scannum(MS2DATA) where MS1MZ=2050:TOLERANCEMZ=50:INTENSITYPERCENT=99.9", None, f"select distinct scan from ms2 where ms1scan in (select scan from ms1 where {band('mz', '2050', '50')} and i_norm > 0.99e0)", ms1=True)
peak_query("ql_scaninfo_norms", FLAGSHIP, ["scan", "ms1scan", named("i_norm_ms1")], f"select scan, max(ms1scan) as ms1scan, {q6('max(n.i_norm)')} as i_norm_ms1 from ms2 left join (select scan as s1, max(i_norm) as i_norm from ms1 group by 1) n on s1 = ms1scan where scan in (select scan from ms2 where {HIT}) group by scan", ms1=True)
peak_query("ql_filter_ms1", "QUERY MS1DATA WHERE RTMAX=5 FILTER MS1MZ=(2000 OR 3000):TOLERANCEMZ=40", ["scan", named("mz"), named("i")], f"select scan, {q6('mz')} as mz, {q6('i')} as i from ms1 where rt < 5 and ({band('mz', '2000', '40')} or {band('mz', '3000', '40')})", ms1=True)
peak_query("ql_ms1_massdefect", "QUERY scannum(MS1DATA, TOLERANCE=0.5) WHERE MS1MZ=2050:TOLERANCEMZ=50:MASSDEFECT=massdefect(min=0.3,max=0.6)", None, f"select distinct scan from ms1 where {band('mz', '2050', '50')} and mz - floor(mz) > 0.3e0 and mz - floor(mz) < 0.6e0", ms1=True)
# masses from tables of residues: G 57.02146, K 128.09496, R 156.10111, S 87.03203; water 18.01056, a proton 1.00728
peak_query("ql_peptide", "QUERY scannum(MS2DATA) WHERE MS2PROD=peptide(GSK, charge=1, ion=y):TOLERANCEMZ=0.4", None, f"select distinct scan from ms2 where {band('frag_mz', str(57.02146 + 87.03203 + 128.09496 + 18.01056 + 1.00728) + 'e0', '0.4e0')}")
peak_query("ql_residues", "QUERY scannum(MS2DATA) WHERE MS2PROD=100+aminoaciddelta(KR):TOLERANCEMZ=0.4", None, f"select distinct scan from ms2 where {band('frag_mz', str(100 + 128.09496 + 156.10111) + 'e0', '0.4e0')}")
peak_query("ql_percent_limit", "QUERY scannum(MS1DATA) WHERE MS1MZ=2050:TOLERANCEMZ=50:INTENSITYPERCENT=100", None, f"select distinct scan from ms1 where {band('mz', '2050', '50')} and i_norm > 0.99e0", ms1=True)
peak_query("ql_nothing", "QUERY scaninfo(MS2DATA) WHERE MS2PROD=99999:TOLERANCEMZ=0.1", ["scan", named("i")], f"select scan, {q6('sum(frag_intens)')} as i from ms2 where false group by scan")
peak_query("ql_arithmetic", "QUERY scannum(MS2DATA) WHERE MS2PROD=2*(100-10.985)+(0.5*0)/3:TOLERANCEMZ=0.5", None, f"select distinct scan from ms2 where {band('frag_mz', '178.03e0', '0.5e0')}")


@register("ql_mobility", f"{PEAKS} select distinct scan from ms2 where rt between 3 and 5.5 and {HIT}")
def ql_mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("QUERY scannum(MS2DATA) WHERE MOBILITY=range(min=3,max=5.5) AND MS2PROD=178.03:TOLERANCEMZ=0.5", None, ms2_peaks(spark, sf_dir).withColumn("mobility", F.col("rt")))


@register(
    "peaks_topn_norm",
    f"""{PEAKS}, n as (select *, frag_intens / max(frag_intens) over (partition by scan) as w from ms2 where frag_mz > 0),
    k as (select *, row_number() over (partition by scan order by w desc, frag_mz, loss_mz) as rank from n where frag_mz between 0 and 1000 and w between 0.1e0 and 1)
    select scan, {q6('sum(w)')} as w, {q6('max(frag_mz)')} as top_mz, count(*) as n from k where rank <= 5 group by scan having count(*) >= 3""",
)
def peaks_topn_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.clean(ms2_peaks(spark, sf_dir), low=0.1, top=5).groupBy("scan").agg(r6(F.sum("w")).alias("w"), r6(F.max("frag_mz")).alias("top_mz"), F.count("*").alias("n"))


WORDS = f"{PEAKS}, words as ({WORDS_SQL.format(half_even='cast(round_even(100e0*w, 0) as bigint)')})"


@register("corpus_word_counts", f"{WORDS} select * from words")
def corpus_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.words(ms2_peaks(spark, sf_dir), parts=scan_parts(spark, sf_dir))


@register("corpus_vocabulary", f"{WORDS} select word, sum(n)::bigint as cf, count(distinct scan) as df from words group by word having sum(n) >= 50 and count(distinct scan) >= 2")
def corpus_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.vocabulary(peaks.words(ms2_peaks(spark, sf_dir), parts=scan_parts(spark, sf_dir)), 50, 2)


@register("vocabulary_without_top", f"{WORDS}, v as (select word, sum(n)::bigint as cf, count(distinct scan) as df from words group by word having count(distinct scan) >= 2) select word, cf, df from (select *, row_number() over (order by cf desc, word) as k from v) where k > 25")
def vocabulary_without_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.vocabulary(peaks.words(ms2_peaks(spark, sf_dir), parts=scan_parts(spark, sf_dir)), 1, 2, drop_top=25)


@register(
    "completion_split",
    f"""{PEAKS}, p as (select scan, row_number() over (partition by scan order by frag_mz, frag_intens, loss_mz) as peak_idx from ms2),
    r as (select scan, peak_idx, count(*) over (partition by scan) as n, row_number() over (partition by scan order by sha256('42' || chr(0) || scan || chr(0) || peak_idx::varchar)) as k from p)
    select scan, peak_idx::int as peak_idx, k <= greatest(least(round_even(n * 0.5e0, 0), n - 1), 1) as observed from r where n > 1""",
)
def completion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ms2_peaks(spark, sf_dir).withColumn("peak_idx", F.row_number().over(Window.partitionBy("scan").orderBy("frag_mz", "frag_intens", "loss_mz")))
    several = numbered.withColumn("n", F.count("*").over(Window.partitionBy("scan"))).filter("n > 1")
    return peaks.completion_split(several, 42).select("scan", "peak_idx", "observed")


@register("theta_entropy", f"{THETA} select {q6('avg(h)')} as entropy from (select doc, sum(-p * ln(case when p = 0 then 1e-12 else p end)) as h from theta group by doc)")
def theta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.entropy(theta(spark, sf_dir), "doc").select(r6("entropy").alias("entropy"))


@register("topic_top_words", f"{THETA} select topic, word, {q6('p')} as p, rank::int as rank from (select *, row_number() over (partition by topic order by p desc, word) as rank from beta) where rank <= 10")
def topic_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.top_words(beta(spark, sf_dir)).select("topic", "word", r6("p").alias("p"), "rank")


@register("theta_dominant", f"{THETA} select doc, topic, {q6('p')} as p from (select *, row_number() over (partition by doc order by p desc, topic) as k from theta) where k = 1")
def theta_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.dominant(theta(spark, sf_dir)).select("doc", "topic", r6("p").alias("p"))


@register(
    "theta_motif_degree",
    f"""{THETA}, o as (select doc, topic, p * 10 as overlap from theta), i as (select t.topic, t.p, o.overlap from theta t join o using (doc, topic) where t.p between 0.05e0 and 1 and overlap between 0.3e0 and 1)
    select topic, count(i.p) as degree, {q6('coalesce(avg(i.p), 0)')} as mean_p, {q6('coalesce(avg(overlap), 0)')} as mean_overlap from (select distinct topic from theta) left join i using (topic) group by topic""",
)
def theta_motif_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    overlaps = t.select("doc", "topic", (F.col("p") * 10).alias("overlap"))
    return topics.degrees(t, overlaps, (0.05, 1.0), (0.3, 1.0)).select("topic", "degree", r6("mean_p").alias("mean_p"), r6("mean_overlap").alias("mean_overlap"))


@register(
    "topic_active",
    f"""{THETA}, d as (select doc, sum((p >= 0.03)::int) as n from theta group by doc), c as (select topic, avg(p) as p from theta group by topic)
    select {q6('avg(n)')} as mean, {q6('quantile_cont(n, 0.5)')} as median, {q6('quantile_cont(n, 0.95)')} as p95, (select sum((p >= 0.0155)::int)::bigint from c) as corpus from d""",
)
def topic_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    out = topics.active(t, 0.03).select(*(r6(c).alias(c) for c in ("mean", "median", "p95")))
    corpus = t.groupBy("topic").agg(F.avg("p").alias("p")).agg(F.sum((F.col("p") >= 0.0155).cast("int")).alias("corpus"))
    return out.crossJoin(corpus)  # one row each


@register("topic_diversity", f"{THETA} select {q6('count(distinct word) * 1e0 / count(word)')} as diversity from (select word, row_number() over (partition by topic order by p desc, word) as k from beta) where k <= 10")
def topic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.diversity(beta(spark, sf_dir)).select(r6("diversity").alias("diversity"))


@register(
    "topic_npmi",
    f"""{THETA}, docs as (select distinct (word * 7 + k * 13) % 97 as doc, word from (select distinct word from beta), range(5) r(k)),
    top as (select * from (select topic, word, row_number() over (partition by topic order by p desc, word) as rank from beta) where rank <= 5),
    pairs as (select a.topic, a.word as v, b.word as w from top a join top b on a.topic = b.topic and a.rank < b.rank),
    s as (select word, count(*) as c from docs group by word), d as (select count(distinct doc) as d from docs),
    b as (select v, w, count(*) as c from (select distinct v, w from pairs) join docs x on x.word = v join docs y on y.word = w and y.doc = x.doc group by v, w)
    select topic, {q6('avg(case when b.c is null then -1 when b.c = d then 1 else ln((b.c * 1e0 / d) / (sv.c * 1e0 / d * sw.c / d)) / -ln(b.c * 1e0 / d) end)')} as npmi
    from pairs left join b using (v, w) left join s sv on sv.word = v left join s sw on sw.word = w cross join d group by topic""",
)
def topic_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beta(spark, sf_dir)
    docs = b.select("word").distinct().select(F.explode(F.array(*[(F.col("word") * 7 + k * 13) % 97 for k in range(5)])).alias("doc"), "word").distinct()
    return topics.npmi(b, docs, 5).select("topic", r6("npmi").alias("npmi"))


@register(
    "document_likelihood",
    f"""{THETA}, n as (select id as doc, (id * 31 + k * 17) % 500 as word, k + 1 as n from (select distinct id from cells), range(4) r(k)),
    t as (select n.doc, n.word, max(n.n) as n, sum(theta.p * beta.p) as p from n join theta on theta.doc = n.doc join beta on beta.word = n.word and beta.topic = theta.topic group by n.doc, n.word)
    select {q6('sum(-n * ln(greatest(p, 1e-12))) / sum(n)')} as nll, {q6('1 - sum(n) * 1e0 / (select sum(n) from n)')} as unknown from t""",
)
def document_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = theta(spark, sf_dir), beta(spark, sf_dir)
    cells = F.array(*[F.struct(((F.col("doc") * 31 + k * 17) % 500).alias("word"), F.lit(k + 1).alias("n")) for k in range(4)])
    counts = t.select("doc").distinct().select("doc", F.inline(cells))
    return topics.likelihood(counts, t, b).select(r6("nll").alias("nll"), r6("unknown").alias("unknown"))


@register(
    "embedding_cosine_top",
    f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v),
    s as (select q.vec_id as query, l.vec_id as id, list_sum(list_transform(range(1, 65), lambda k: q.e[k] * l.e[k])) as score from u q join u l on true)
    select query, id, {q6('score')} as score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 5""",
)
def embedding_cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    library = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = table.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return similarity.cosine_top(library, queries, 5).select("query", "id", r6("score").alias("score"), "rank")


@register(
    "fingerprint_screen",
    f"""with f as (select vec_id, list_filter(range(0, 64), lambda k: embedding[k + 1] > 0) as s from embeddings),
    p as (select a.vec_id as a, b.vec_id as b, len(list_intersect(a.s, b.s)) as c, len(a.s) as na, len(b.s) as nb from f a join f b on a.vec_id <> b.vec_id)
    select a, b, {q6('c * 1e0 / (na + nb - c)')} as score from p where c * 1e0 / (na + nb - c) >= 0.5e0""",
)
def fingerprint_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("a"), similarity.bits(F.col("embedding")).alias("set"))
    return similarity.screen(sets, sets.withColumnRenamed("a", "b"), 0.5).filter("a <> b").select("a", "b", r6("score").alias("score"))


@register(
    "fingerprint_consensus",
    "with c as (select label, unnest(range(64))::int as pos, (unnest(embedding) > 0)::int as b from embeddings) select label, pos, (avg(b) >= 0.55)::int as bit from c group by label, pos",
)
def fingerprint_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    return similarity.consensus(prints, "label", 0.55)


@register(
    "network_document_edges",
    f"""{THETA}, k as (select doc, topic, p, p * 10 as overlap, row_number() over (partition by doc order by p desc, topic) as rank from theta where p >= 0.04e0 and p * 10 >= 0.3e0)
    select doc, topic, {q6('p')} as p, {q6('overlap')} as overlap, rank::int as rank from k where rank <= 3""",
)
def network_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    edges = network.document_edges(t, t.select("doc", "topic", (F.col("p") * 10).alias("overlap")), 0.04, 0.3)
    return edges.select("doc", "topic", r6("p").alias("p"), r6("overlap").alias("overlap"), "rank")


@register("lda_fit_infer")
def lda_fit_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the peak corpus by variational Bayes, then every scan's mixture under them."""
    corpus = settle(peaks.words(ms2_peaks(spark, sf_dir), digits=0).withColumnRenamed("scan", "doc"), "corpus")  # for the vocabulary and the bags
    vocabulary = peaks.vocabulary(corpus.withColumnRenamed("doc", "scan"), 1, 2).orderBy("word").select("word")
    words = [r["word"] for r in vocabulary.toLocalIterator()]  # whole m/z units: about a thousand
    ids = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, id int")
    docs = settle(lda.bags(corpus, ids).repartition(spark.sparkContext.defaultParallelism), "bags")  # read by each epoch, whose work is in the arrays: as many parts as cores
    model = lda.fit(docs, words, topics=10, epochs=4)
    return lda.infer(docs, model)


# motifs: scans of charge 1; spectra: scans of charge 2; every fragment's and every loss's intensity as a share of the scan's sum, so that the sums have limits to meet
SIDES = f"""{PEAKS}, w as (select scan, charge, frag_mz, loss_mz, frag_intens / sum(frag_intens) over (partition by scan) as i from ms2),
    kinds as (select scan, charge, 'frag' as kind, 0.005e0 as margin, frag_mz as mz, i from w union all select scan, charge, 'loss', 0.01e0, loss_mz, i from w where loss_mz is not null),
    m as (select scan as motif, kind, margin, mz as feature, max(i) as mi from kinds where charge = 1 group by 1, 2, 3, 4),
    s as (select scan as spectrum, kind, mz as peak, i as si from kinds where charge = 2),
    b as (select *, floor(feature / margin)::bigint + k as bin from m, (values (-1), (0), (1)) v(k)),
    f as (select motif, spectrum, b.kind, feature, mi, min(struct_pack(peak := peak, si := si)) as f from s join b on s.kind = b.kind and floor(peak / margin)::bigint = bin where abs(peak - feature) <= margin group by all)"""


@register(
    "screen_overlap",
    f"""{SIDES}, g as (select motif, spectrum, count(*) as n, sum(mi) as total, max(mi) > min(mi) and max(f.si) > min(f.si) as varied, corr(mi, f.si) as r from f group by motif, spectrum),
    x as (select motif, spectrum, n, total, case when varied then r else 0 end as r from g)
    select motif, spectrum, n, {named('total')}, {named('r')}, case when n >= 3 and total >= 0.9e0 and r >= 0.7e0 then 'A' when n >= 3 and total >= 0.9e0 and r >= 0.5e0 then 'B' when n >= 2 and total >= 0.5e0 and r >= 0.3e0 then 'C' when n >= 2 and total >= 0.8e0 then 'D' end as grade from x""",
)
def screen_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("frag_intens") / F.sum("frag_intens").over(Window.partitionBy("_key", "scan"))
    table = ms2_peaks(spark, sf_dir, keyed=True)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_mz").alias("mz")) for k in ("frag", "loss")])
    side = lambda charge, name: table.filter(F.col("charge") == charge).withColumn("i", share).select("_key", F.col("scan").alias(name), "i", F.inline(kinds)).filter("mz is not null")
    out = screening.overlap_screen(side(1, "motif"), side(2, "spectrum"))
    return out.select("motif", "spectrum", "n", r6("total").alias("total"), r6("r").alias("r"), "grade")


@register(
    "screen_shared_features",
    f"""{PEAKS}, h as (select ms1scan as motif, scan as hit, floor(frag_mz / 100e0 + 0.5e0) as feature from ms2), c as (select motif, count(distinct hit) as hits from h group by motif)
    select motif, feature * 1e0 as feature from (select motif, feature, count(distinct hit) as n from h group by 1, 2) join c using (motif) where n = hits""",
)
def screen_shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ms2_peaks(spark, sf_dir).select(F.col("ms1scan").alias("motif"), F.col("scan").alias("hit"), (F.col("frag_mz") / 100.0).alias("mz"))
    return screening.shared_features(hits, 0).withColumn("feature", F.col("feature").cast("double"))


@register(
    "spectra_search",
    f"{PEAKS} select scan, {q6('max(precmz)')} as precmz from ms2 where precmz between 500 and 2500 and (abs(frag_mz - 300.5e0) <= 0.5e0 or coalesce(abs(loss_mz - 300.5e0) <= 0.5e0, false)) group by scan",
)
def spectra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.search(ms2_peaks(spark, sf_dir), 500, 2500, "300.5", losses=True, margin=0.5).select("scan", r6("precmz").alias("precmz"))


@register("spectra_bounds", f"{PEAKS} select floor(greatest(min(precmz) - 50, 0) / 10)::bigint * 10 as low, floor((max(precmz) + 59) / 10)::bigint * 10 as high from ms2")
def spectra_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.slider_bounds(ms2_peaks(spark, sf_dir))


@register(
    "word_nearest_peak",
    f"""{PEAKS}, p as (select scan as doc, row_number() over (partition by scan order by frag_mz, frag_intens, loss_mz)::int as peak_idx, frag_mz as mz, precmz as precursor from ms2),
    w as (select scan as doc, 'frag@' || (floor(frag_mz + 0.5e0))::bigint as word, 'frag' as kind, floor(frag_mz + 0.5e0) as value from ms2
          union select scan, 'loss@' || (floor(loss_mz + 0.5e0))::bigint, 'loss', floor(loss_mz + 0.5e0) from ms2 where loss_mz is not null),
    h as (select p.doc, word, abs((case kind when 'frag' then mz else precursor - mz end) - value) as delta, peak_idx from p join w using (doc))
    select doc, word, peak_idx, {named('delta')} from (select *, row_number() over (partition by doc, word order by delta, peak_idx) as k from h where delta <= 0.5e0) where k = 1""",
)
def word_nearest_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ms2_peaks(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("scan").orderBy("frag_mz", "frag_intens", "loss_mz"))
    numbered = table.select(F.col("scan").alias("doc"), place.alias("peak_idx"), F.col("frag_mz").alias("mz"), F.col("precmz").alias("precursor"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.floor(F.col(f"{k}_mz") + 0.5).cast("double").alias("value")) for k in ("frag", "loss")])
    words = table.select(F.col("scan").alias("doc"), F.inline(kinds)).filter("value is not null").distinct()
    words = words.withColumn("word", F.concat("kind", F.lit("@"), F.col("value").cast("bigint").cast("string")))
    return screening.nearest_peaks(words, numbered, 0.5).select("doc", "word", "peak_idx", r6("delta").alias("delta"))


@register(
    "screen_top_hits",
    f"""{THETA}, k as (select topic, doc, p, row_number() over (partition by topic order by p desc, doc) as rank from theta)
    select topic, string_agg('set|' || doc || '(' || printf('%.2f', p * 100e0) || ')', '; ' order by rank) as text from k where rank <= 3 group by topic""",
)
def screen_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = theta(spark, sf_dir).select(F.col("topic").alias("motif"), F.lit("set").alias("set"), F.col("doc").alias("id"), (F.col("p") * 100).alias("score"))
    return screening.top_hits(hits).withColumnRenamed("motif", "topic")


@register(
    "mixture_diagnostics",
    f"""{THETA}, d as (select doc, max(p) as m, exp(sum(-p * ln(case when p = 0 then 1e-12 else p end))) as wide from theta group by doc),
    b as (select count(distinct topic) as n from (select topic, row_number() over (partition by doc order by p desc, topic) as k from theta) where k = 1)
    select (select n from b) as dominant_topics, {q6('quantile_cont(m, 0.5)')} as max_median, {q6('quantile_cont(m, 0.95)')} as max_p95, {q6('max(m)')} as max_max, {q6('quantile_cont(wide, 0.5)')} as wide_median, count(*) filter (m >= 0.05e0) as crossing_docs, (select count(distinct topic) from theta where p >= 0.05e0) as crossing_topics from d""",
)
def mixture_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mixture_diagnostics(theta(spark, sf_dir)).select("dominant_topics", *(r6(c).alias(c) for c in ("max_median", "max_p95", "max_max", "wide_median")), "crossing_docs", "crossing_topics")


@register(
    "mixture_distances",
    f"""{THETA}, u as (select doc, topic, p as a, lag(p, 1, 0) over (partition by doc order by topic) as b from theta),
    g as (select doc, sum(a * b) as ab, sum(a * a) as aa, sum(b * b) as bb, sum(case when a > 0 then a * ln(a / ((a + b) / 2)) else 0 end + case when b > 0 then b * ln(b / ((a + b) / 2)) else 0 end) / 2 as js from u group by doc)
    select doc, {q6('case when aa > 0 and bb > 0 then ab / sqrt(aa * bb) else 0 end')} as cosine, {named('js')} from g""",
)
def mixture_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    shifted = t.filter("topic < 63").withColumn("topic", F.col("topic") + 1)
    return metrics.mixture_distances(t, shifted).select("doc", r6("cosine").alias("cosine"), r6("js").alias("js"))


@register(
    "seed_aggregate",
    "select o_orderstatus || ':' || o_orderpriority as arm, quantile_cont(o_totalprice, 0.5) as median, min(o_totalprice) as min, max(o_totalprice) as max, count(*) as n from (select o_orderstatus, o_orderpriority, o_totalprice::double as o_totalprice from orders) group by arm",
)
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("arm"), F.col("o_totalprice").cast("double").alias("value"))
    return summaries.across_seeds(rows, "arm")


@register(
    "convergence_steps",
    """with h as (select o_custkey as run, o_orderkey as step, o_totalprice::double as v from orders), c as (select *, abs(v - lag(v) over w) / abs(lag(v) over w) < 0.5e0 as calm from h window w as (partition by run order by step))
    select run, step, coalesce(sum(calm::int) over (partition by run order by step rows 2 preceding), 0) = 3 as stable from c""",
)
def convergence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("value"))
    return summaries.converged(rows, 0.5, 3, "run").drop("value")


@register(
    "audit_counts",
    """with c as (select o_custkey as k, count(*) as n from orders group by 1)
    select sum(n)::bigint as n_rows, count(k) as n_keys, coalesce(sum(n) filter (k is null), 0)::bigint as n_missing, count(*) filter (k is not null and n > 1) as n_repeated, coalesce(sum(n - 1) filter (k is not null), 0)::bigint as n_extra from c""",
)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.audit(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


@register(
    "leakage_audit",
    "select o_custkey, count(distinct o_orderstatus) as splits from orders group by o_custkey having count(distinct o_orderstatus) > 1",
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leakage(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderstatus")


@register(
    "precursor_histogram",
    "with b as (select k as bin, k * 500e0 as low, k * 500e0 + 500 as high from range(10) r(k)) select bin::int as bin, count(v) as n from b left join (select o_totalprice / 100e0 as v from orders) on v > low and v <= high group by bin",
)
def precursor_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_totalprice") / 100.0).alias("v"))
    return summaries.histogram(rows, F.col("v"), [500.0 * k for k in range(11)])


@register(
    "feature_frequency",
    f"{PEAKS}, r as (select distinct scan, floor(frag_mz) as item from ms2) select item::bigint as item, count(*) as n from r group by item having count(*) > floor((select count(distinct scan) from ms2) * 0.005e0)",
)
def feature_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.frequent(ms2_peaks(spark, sf_dir).select("scan", F.floor("frag_mz").alias("item")), "scan", "item")


@register(
    "curated_first",
    "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'F') where k = 1",
)
def curated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return summaries.curated(rows, "o_custkey", "o_orderkey")


@register(
    "vocabulary_order",
    f"{PEAKS}, f as (select floor(frag_mz)::bigint as word, min(struct_pack(doc := scan, pos := frag_mz)) as f from ms2 group by 1) select word, row_number() over (order by f)::int as place from f",
)
def vocabulary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.first_places(ms2_peaks(spark, sf_dir).select(F.col("scan").alias("doc"), F.col("frag_mz").alias("pos"), F.floor("frag_mz").alias("word")))


@register(
    "unknown_words",
    f"{WORDS}, v as (select word from words group by word having sum(n) >= 50 and count(distinct scan) >= 2) select scan as doc, sum(n)::bigint as n, coalesce(sum(n) filter (word not in (select word from v)), 0)::bigint as unknown from words group by scan",
)
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = peaks.words(ms2_peaks(spark, sf_dir), parts=scan_parts(spark, sf_dir))
    return summaries.unknown_words(corpus.withColumnRenamed("scan", "doc"), peaks.vocabulary(corpus, 50, 2))


@register(
    "topic_feature_counts",
    f"""{THETA}, n as (select distinct doc, (doc * 31 + k * 17) % 500 as word from (select distinct doc from theta), range(4) r(k))
    select word, count(distinct doc) as docs from n where doc in (select doc from theta where topic = 3 and p between 0.02e0 and 1) group by word""",
)
def topic_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir)
    documents = t.select("doc").distinct().select("doc", F.explode(F.array(*[(F.col("doc") * 31 + k * 17) % 500 for k in range(4)])).alias("word"))
    return summaries.feature_counts(documents, t, 3, 0.02)


MAPS = sketches.permutations(16)
SKETCH = f"""with p as (select p_partkey, p_name from part), g as (select p_partkey, list_distinct([substr(p_name, k, 4) for k in range(1, length(p_name) - 2)]) as s from p),
    h as (select p_partkey, [('0x' || substr(sha1(x), 1, 8))::bigint % {sketches.PRIME} for x in s] as h from g),
    m as (select p_partkey, h, [{", ".join(f"coalesce(list_min([(x * {a} + {b}) % {sketches.PRIME} for x in h]), {sketches.PRIME})" for a, b in MAPS)}] as sketch from h)"""


@register(
    "sketch_minhash",
    SKETCH + " select p_partkey, list_aggregate(sketch, 'sum')::bigint as total, list_sort(list_distinct([x % 1024 for x in h]))::varchar as bits, 1 - list_sum([(sketch[k] = o.other[k])::int for k in range(1, 17)]) / 16e0 as distance from m cross join (select sketch as other from m where p_partkey = 1) o",
)
def sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // 20_000))  # a small file is one split, and its sketches are work
    table = rows.repartition(parts).select("p_partkey", sketches.lingo(F.col("p_name")).alias("s")).withColumn("sketch", sketches.minhash(F.col("s"), MAPS))
    first = table.filter("p_partkey = 1").select(F.col("sketch").alias("other"))
    total = F.aggregate("sketch", F.lit(0).cast("bigint"), lambda a, x: a + x)
    bits = F.concat(F.lit("["), F.array_join(sketches.folded(F.col("s"), 1024).cast("array<string>"), ", "), F.lit("]"))
    return table.crossJoin(F.broadcast(first)).select("p_partkey", total.alias("total"), bits.alias("bits"), sketches.distance(F.col("sketch"), F.col("other")).alias("distance"))  # one row


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ql_scaninfo_ms2prod"](spark, sf_dir)


DRAWN = "QUERY scaninfo(MS2DATA) WHERE MS2PROD=(X-322 OR 200):TOLERANCEMZ=0.5 AND MS2NL=500:TOLERANCEMZ=40:EXCLUDED"


@register(
    "drawn_peaks",
    f"""{PEAKS}, m as (select scan, frag_intens, frag_mz, precmz, max(frag_intens) over (partition by scan) as top from ms2), b as (select *, 0 as condition, 0 as value, 'MS2PROD' as field from m where {band('frag_mz', '178', '0.5')}
    union all select *, 0, 1, 'MS2PROD' from m where {band('frag_mz', '200', '0.5')} union all select *, 1, 0, 'MS2NL' from m where precmz - frag_mz > 460 and precmz - frag_mz < 540)
    select scan, condition, value, field, count(*) as n, {q6('max(frag_intens) / max(top)')} as best from b group by 1, 2, 3, 4""",
)
def drawn_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many peaks of each scan lie in each band that a query would draw."""
    out = drawing.drawn_peaks(DRAWN, ms2_peaks(spark, sf_dir), 500.0)
    return out.select("scan", "condition", "value", "field", "n", r6("best").alias("best"))
