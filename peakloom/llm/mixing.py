"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by hash and their words laid end to end, cut into blocks of equal length, shorter
ones where a source's target would else be less than SOURCE_SLOTS blocks (one word at least). Slot i
of the schedule is given to the source whose share of the cumulative blocks wanted holds the golden-ratio point frac(i * phi);
the k-th slot of a source takes its block k modulo its number of blocks, so a source is never read a second time before
it has been read once. The result is the list of pieces (slot, document, first and last word), which a writer can read
in slot order.

No step gathers a source in one task: prefix sums go through hash buckets (source, bucket), whose totals are summed in
a second, small window; ranks of slots go through chunks of consecutive slots; slots meet the cumulative shares on a grid
of equal bins, an equi-join, and blocks meet slots on (source, block).

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source, sorted last;
a repeated row is a document of its own; documents whose hashes tie are ordered by doc_id and then content; an empty
table gives an empty result. Other columns are ignored by `pieces`; `resample` carries them, whatever their names and types. A text is
only counted, by Spark's own functions, so its length needs no more memory than the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, quoted, settle, text_key, unused

GOLDEN = 0.6180339887498949
SLOTS = 1 << 20  # about how many slots a schedule has, besides those of small sources
SOURCE_SLOTS = 1024  # the least number a source has, if it has as many words: targets are met to a few blocks
GRID = 1024
CHUNK = 4096
BUCKET_ROWS = 20_000
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size, docs) with sid, weight and target: water-filling under caps of cap * source_size.

    Sources are ordered by cap / weight; as long as the level reached by spreading what is left over the weights that
    are left lies above a source's cap / weight, the source is capped. Rows here are sources, not documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "sid")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("pos", F.row_number().over(by_cap)).withColumn("level", level).withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.col("pos"))).over(everything))
    height = F.max(F.when(F.col("pos") == F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open").isNull() | (F.col("pos") < F.col("open")), F.col("cap")).otherwise(height * F.col("weight"))
    return out.withColumn("target", target).select("source", "sid", "source_size", "docs", "target")


def sized(docs: DataFrame, text: str, source: str, key: str, row: Column) -> DataFrame:
    """One small row for each document: doc_id, source, size, its place in the shuffled order, and its content's key."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(key), F.lit(17), F.col(text)).alias("place"),  # with the text, as many rows may have one doc_id or none
        row.alias("row_key"),
    )


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, block): which block of which source each slot takes."""
    spark = plan.sparkSession
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.col("target") / F.col("block_words")
    shares = plan.withColumn("high", F.sum(wanted).over(running) / F.sum(wanted).over(Window.partitionBy()))
    last = F.max("sid").over(Window.partitionBy())
    shares = (
        shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
        .withColumn("high", F.when(F.col("sid") == last, F.lit(2.0)).otherwise(F.col("high")))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.floor(F.least(F.col("high"), F.lit(0.999999)) * GRID))))
        .select("sid", "low", "high", "blocks", "bin")
    )
    point = (F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)
    parts = max(1, min(256, slots // (1 << 15)))
    taken = (
        spark.range(0, slots, 1, parts)
        .select(F.col("id").alias("slot"), point.alias("point"), F.floor(point * GRID).alias("bin"), F.floor(F.col("id") / CHUNK).alias("chunk"))
        .join(shares, "bin")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    )
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = taken.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(before, ["sid", "chunk"])
    rank = F.col("before") + F.col("rank")
    return ranked.withColumn("rank", rank).filter(F.col("rank") < 2 * F.col("blocks")).select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"))


def laid_out(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """rows with sid, bucket, seq and start: the words of the same source before each document in the shuffled order."""
    rows = rows.join(plan.select(F.col("source").alias("its_source"), "sid", "source_size", "target", "block_words"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("place", 7), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "row_key")
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = rows.withColumn("seq", F.row_number().over(inside)).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return rows.join(totals, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("before")).drop("before")


def pieces(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", row: Column | None = None, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents laid out, pieces). A piece is a slot with words low..high of one document; the order of slots is the mix."""
    rows = settle(sized(docs, text, source, key, F.lit("") if row is None else row), "mix-sizes")
    plan = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), share, cap, weights), "mix-targets")
    total, n_docs = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    block_words = F.greatest(F.lit(1), F.least(F.lit(int(total // slots)), F.floor(F.col("target") / SOURCE_SLOTS))).cast("long")
    plan = plan.withColumn("block_words", block_words)
    slots = round(plan.agg(F.coalesce(F.sum(F.col("target") / F.col("block_words")), F.lit(0.0))).first()[0])
    block = F.col("block_words")
    laid = settle(laid_out(rows, plan, max(16, n_docs // BUCKET_ROWS)), "mix-layout")
    cut = (
        laid.filter(F.col("size") > 0)
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        .withColumn("low", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)))
        .withColumn("high", F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")))
    )
    out = cut.join(schedule(plan, slots), ["sid", "block"])
    return laid, out.select("slot", "sid", "bucket", "seq", "doc_id", "row_key", "low", "high")


def taken(laid: DataFrame, cut: DataFrame) -> DataFrame:
    """laid with `taken`: the words that all pieces of a document hold."""
    words = cut.groupBy("sid", "bucket", "seq").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    return laid.join(words, ["sid", "bucket", "seq"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def resample(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options: object) -> DataFrame:
    """docs with every row as many times as the mix takes it, to the nearest whole number: at most one document of each
    source, the one where its last slot ends, is rounded."""
    row_key, twin, copies, copy = unused(docs, "row_key", "twin", "copies", "copy")
    plain = [F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema]  # maps have no hash
    known = docs.withColumn(row_key, F.concat(text_key(quoted(text)), F.xxhash64(*plain).cast("string")))
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    counts = taken(*pieces(known, text, source, key, F.col(row_key), **options)).select(F.col("row_key").alias(row_key), n.alias(copies))
    counts = counts.withColumn(twin, F.row_number().over(Window.partitionBy(row_key).orderBy(F.col(copies).desc()))).filter(F.col(copies) > 0)
    twins = known.withColumn(twin, F.row_number().over(Window.partitionBy(row_key).orderBy(row_key)))
    many = twins.join(counts, [row_key, twin]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return many.select(*(quoted(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid, cut = pieces(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return taken(laid, cut).select("doc_id", "size", "source_size", "target", "taken")
