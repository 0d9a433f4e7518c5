"""Analytics over topic tables: theta (doc, topic, p), beta (topic, word, p), phi (doc, word, topic, p), counts (doc, word, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def entropy(rows: DataFrame, key: str) -> DataFrame:
    """Mean entropy of the distributions by key, in nats."""
    p = F.when(F.col("p") == 0, FLOOR).otherwise(F.col("p"))
    return rows.groupBy(key).agg(F.sum(-p * F.log(p)).alias("h")).agg(F.avg("h").alias("entropy"))


def top_words(beta: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "word"))
    return beta.withColumn("rank", rank).filter(F.col("rank") <= n)


def dominant(theta: DataFrame) -> DataFrame:
    """(doc, topic, p): the likeliest topic, the lowest number of those that tie."""
    best = F.max(F.struct("p", (-F.col("topic")).alias("t"))).alias("b")
    return theta.groupBy("doc").agg(best).select("doc", (-F.col("b.t")).alias("topic"), F.col("b.p").alias("p"))


def overlap(beta: DataFrame, phi: DataFrame, least: float = 0.01) -> DataFrame:
    """(doc, topic, overlap): sum over words of beta times phi."""
    kept = phi.filter(F.col("p") >= least).withColumnsRenamed({"p": "phi"})
    return kept.join(beta, ["topic", "word"]).groupBy("doc", "topic").agg(F.sum(F.col("p") * F.col("phi")).alias("overlap"))


def assignments(tokens: DataFrame) -> DataFrame:
    """phi from (doc, word, topic) rows, one for each token: shares of topics in a document's word."""
    counts = tokens.groupBy("doc", "word", "topic").agg(F.count("*").alias("n"))
    return counts.select("doc", "word", "topic", (F.col("n") / F.sum("n").over(Window.partitionBy("doc", "word"))).alias("p"))


def degrees(theta: DataFrame, overlaps: DataFrame, p: tuple[float, float], o: tuple[float, float]) -> DataFrame:
    """(topic, degree, mean_p, mean_overlap) of documents inside both inclusive ranges; topics without any have 0."""
    inside = theta.join(overlaps, ["doc", "topic"]).filter(F.col("p").between(*p) & F.col("overlap").between(*o))
    found = inside.groupBy("topic").agg(F.count("*").alias("degree"), F.avg("p").alias("mean_p"), F.avg("overlap").alias("mean_overlap"))
    return theta.select("topic").distinct().join(found, "topic", "left").na.fill(0)


def likelihood(counts: DataFrame, theta: DataFrame, beta: DataFrame) -> DataFrame:
    """One row: negative log-likelihood for each token of known words, tokens of known and unknown ones, the share of unknown ones, documents with a known word, all documents."""
    marked = counts.join(beta.select("word").distinct().withColumn("_known", F.lit(1)), "word", "left")
    known = marked.filter("_known = 1").drop("_known")
    cells = known.join(theta.withColumnsRenamed({"p": "t"}), "doc").join(beta, ["topic", "word"])
    tokens = cells.groupBy("doc", "word").agg(F.max("n").alias("n"), F.sum(F.col("t") * F.col("p")).alias("p"))
    scored = tokens.agg(F.sum(-F.col("n") * F.log(F.greatest("p", F.lit(FLOOR)))).alias("nll"), F.sum("n").alias("tokens"))
    whole = marked.agg(F.sum("n").alias("total"), F.countDistinct(F.when(F.col("_known") == 1, F.col("doc"))).alias("eligible"), F.countDistinct("doc").alias("documents"))
    return scored.crossJoin(whole).select((F.col("nll") / F.col("tokens")).alias("nll"), "tokens", (F.col("total") - F.col("tokens")).alias("unknown_tokens"), (1 - F.col("tokens") / F.col("total")).alias("unknown"), "eligible", "documents")  # one row each


def active(theta: DataFrame, least: float) -> DataFrame:
    """Topics at or above `least`: mean, median and 95th percentile over documents, and in the corpus mean."""
    per_doc = theta.groupBy("doc").agg(F.sum((F.col("p") >= least).cast("int")).alias("n")).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"))
    corpus = theta.groupBy("topic").agg(F.avg("p").alias("p")).agg(F.sum((F.col("p") >= least).cast("int")).alias("corpus"))
    return per_doc.crossJoin(corpus)  # one row each


def diversity(beta: DataFrame, n: int = 10) -> DataFrame:
    return top_words(beta, n).agg((F.countDistinct("word") / F.count("word")).alias("diversity"))


def npmi(beta: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """(topic, npmi, undefined): mean over pairs of a topic's top words by co-occurrence in docs (doc, word); pairs that never meet count as -1 and are counted."""
    top = top_words(beta, n).select("topic", "word", "rank")
    pairs = top.alias("a").join(top.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") < F.col("b.rank"))).select("a.topic", F.col("a.word").alias("v"), F.col("b.word").alias("w"))
    wanted = docs.join(top.select("word").distinct(), "word", "left_semi").distinct()
    single = wanted.groupBy("word").agg(F.count("*").alias("c"))
    asked = pairs.select("v", "w").distinct()
    both = asked.join(wanted.withColumnsRenamed({"word": "v"}), "v").join(wanted.withColumnsRenamed({"word": "w"}), ["w", "doc"]).groupBy("v", "w").agg(F.count("*").alias("c"))
    total = docs.agg(F.countDistinct("doc").alias("d"))
    cells = pairs.join(both, ["v", "w"], "left").join(single.withColumnsRenamed({"word": "v", "c": "cv"}), "v", "left").join(single.withColumnsRenamed({"word": "w", "c": "cw"}), "w", "left").crossJoin(total)
    joint = F.col("c") / F.col("d")
    value = F.log(joint / (F.col("cv") / F.col("d") * F.col("cw") / F.col("d"))) / -F.log(joint)
    return cells.groupBy("topic").agg(F.avg(F.when(F.col("c").isNull(), -1.0).when(joint == 1, 1.0).otherwise(value)).alias("npmi"), F.count(F.when(F.col("c").isNull(), 1)).alias("undefined"))


def npmi_summary(rows: DataFrame) -> DataFrame:
    """One row of npmi's result: mean and median over topics, and the pairs that never meet."""
    return rows.agg(F.avg("npmi").alias("mean"), F.percentile("npmi", F.lit(0.5)).alias("median"), F.sum("undefined").alias("undefined"))


def word_evidence(cells: DataFrame, word_topic: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, topic, p): word_topic (word, topic, p) averaged over each document's words (doc, word, n), as shares; documents without words are even."""
    found = cells.join(word_topic, "word").groupBy("doc", "topic").agg(F.sum(F.col("n") * F.col("p")).alias("s"))
    every = documents.select("doc").distinct().join(cells.groupBy("doc").agg(F.sum("n").alias("_total")), "doc", "left").crossJoin(F.broadcast(word_topic.select("topic").distinct()))  # a row for each topic
    rows = every.join(found, ["doc", "topic"], "left").withColumn("s", F.when(F.coalesce("_total", F.lit(0)) > 0, F.coalesce("s", F.lit(0.0))).otherwise(1.0))
    total = F.sum("s").over(Window.partitionBy("doc"))
    return rows.select("doc", "topic", (F.col("s") / F.greatest(total, F.lit(FLOOR))).alias("p"))


def of_document(theta: DataFrame, doc: object, least: float = 0.01) -> DataFrame:
    """A document's topics of at least that share, the largest first."""
    return theta.filter((F.col("doc") == F.lit(doc)) & (F.col("p") >= least)).orderBy(F.desc("p"), "topic")


def exported(theta: DataFrame, beta: DataFrame, phi: DataFrame | None = None, least: tuple[float, float, float] = (1e-2, 1e-3, 1e-2), gamma: DataFrame | None = None) -> dict[str, DataFrame]:
    """theta and beta above, and phi from, their limits, and gamma whole: what a viewer is given."""
    out = {"theta": theta.filter(F.col("p") > least[0]), "beta": beta.filter(F.col("p") > least[1])}
    out |= {} if phi is None else {"phi": phi.filter(F.col("p") >= least[2])}
    return out if gamma is None else out | {"gamma": gamma}


def with_metadata(theta: DataFrame, metadata: DataFrame) -> DataFrame:
    """Documents' topics beside what is known of them: inner, on doc."""
    return theta.join(metadata, "doc")


def shares(peaks: DataFrame, theta: DataFrame, beta: DataFrame, tol: float = 0.02) -> DataFrame:
    """(doc, peak_idx, topic, share): each topic's part in a peak, theta times beta of the features within tol.

    peaks (doc, peak_idx, mz, precursor); beta (topic, kind, value, p). Fragments match m/z, losses precursor - m/z;
    features meet peaks in bins as wide as the tolerance.
    """
    sides = peaks.select("doc", "peak_idx", F.explode(F.array(F.struct(F.lit("frag").alias("kind"), F.col("mz").alias("at")), F.struct(F.lit("loss").alias("kind"), (F.col("precursor") - F.col("mz")).alias("at")))).alias("s")).select("doc", "peak_idx", "s.kind", "s.at")
    sides = sides.withColumn("bin", F.floor(F.col("at") / tol))
    reach = tol + 1e-9  # a difference that rounding takes past the tolerance may lie a bin farther
    near = beta.withColumn("bin", F.explode(F.sequence(F.floor((F.col("value") - reach) / tol), F.floor((F.col("value") + reach) / tol))))
    hits = sides.join(near, ["kind", "bin"]).filter(F.abs(F.col("at") - F.col("value")) <= tol + 1e-12)
    weighed = hits.join(theta.withColumnsRenamed({"p": "t"}), ["doc", "topic"]).groupBy("doc", "peak_idx", "topic").agg(F.sum(F.col("t") * F.col("p")).alias("s"))
    return weighed.select("doc", "peak_idx", "topic", (F.col("s") / F.sum("s").over(Window.partitionBy("doc", "peak_idx"))).alias("share"))
