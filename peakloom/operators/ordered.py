"""What needs all rows in one order, without a task that holds them: ranks, the next value, greedy covers of a line.

Rows are dealt by range into sorted partitions. What goes from one partition to the next is one number for each, so the driver sees as
many rows as there are partitions, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Values of a line that one task takes at most, about: parts are half as large in the mean.
PART_ROWS = 1_000_000


def carried(df: DataFrame, values: dict[int, float | int], name: str, kind: str) -> DataFrame:
    """df with a value for each of its parts (`_part`); a row for each partition, so its broadcast is small."""
    table = df.sparkSession.createDataFrame(list(values.items()), f"_part bigint, {name} {kind}")
    return df.join(F.broadcast(table), "_part", "left")


def numbered(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """df with `name`, the number of each row, from 0 on, in an order; rows that tie are numbered in any order."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    ahead, total = {}, 0
    for part, rows in sorted((r["_part"], r["rows"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("rows")).collect()):
        ahead[part], total = total, total + rows
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return carried(dealt, ahead, "_ahead", "bigint").withColumn(name, F.col("_ahead") + within).drop("_at", "_part", "_ahead")


def next_values(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(x, y): for each of asked (x, ahead) the least of values (x) that is at least `ahead`; null if there is none."""
    events = values.select(F.col("x").alias("at"), F.lit(True).alias("there"), F.lit(None).cast("double").alias("x"))
    events = events.unionByName(asked.select(F.col("ahead").alias("at"), F.lit(False).alias("there"), "x"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Events from above: each question gets the value seen last; the last row of a partition hands its own on."""
        last, part = np.nan, TaskContext.get().partitionId()
        for b in batches:
            at, there = b["at"].to_numpy(), b["there"].to_numpy(zero_copy_only=False)
            seen = np.maximum.accumulate(np.where(there, np.arange(len(at)), -1)) if len(at) else np.zeros(0, np.int64)
            y = np.where(seen >= 0, at[seen], last)
            ask = np.flatnonzero(~there)
            yield pa.RecordBatch.from_arrays([b["x"].take(pa.array(ask)), pa.array(y[ask], from_pandas=True), pa.array(np.full(len(ask), part))], ["x", "y", "_part"])
            last = y[-1] if len(y) else last
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.float64()), pa.array([last], from_pandas=True), pa.array([part])], ["x", "y", "_part"])

    by = [F.desc("at"), F.desc("there")]  # of equal numbers the value comes first
    found = settle(events.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(rows, "x double, y double, _part bigint"), "next-values")
    before, last = {}, None
    for part, y in sorted((r["_part"], r["y"]) for r in found.filter("x is null").collect()):
        before[part], last = last, last if y is None else y
    return carried(found.filter("x is not null"), before, "_before", "double").select("x", F.coalesce("y", "_before").alias("y"))


def walk(x: np.ndarray, reach: np.ndarray, start: int) -> list[int]:
    """Places of the ascending values that are kept from `start` on, each hiding those less than its reach ahead."""
    out = []
    while start < len(x):
        out.append(start)
        start = max(start + 1, int(np.searchsorted(x, x[start] + reach[start])))
    return out


def cover(points: DataFrame) -> DataFrame:
    """(x): the values that a greedy pass over points (x, reach) from the least on keeps: the first, then the next one that the reach of the
    last one kept does not hide (x + reach is free again).

    Parts of the line are walked apart. From every value that a part may be entered at, the walk through it is followed to where it
    leaves, all values at once by doubling their jumps; the next value from there on is found by a merge, so each entry points at the
    entry of a later part. The entries on the way from the least value are marked by doubling these pointers, in a number of
    rounds that is the logarithm of the number of parts; then each part is walked from its own.
    """
    points = settle(points.select("x", "reach").distinct(), "cover-points")
    parts = -(-2 * points.count() // PART_ROWS)
    spark = points.sparkSession

    def ascending(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(table["x"].to_numpy(), kind="stable")
        return table["x"].to_numpy()[order], table["reach"].to_numpy()[order]

    def kept(table: pa.Table) -> pa.Table:
        x, reach = ascending(table)
        start = int(np.searchsorted(x, table["entry"][0].as_py()))
        return pa.table({"x": pa.array(x[walk(x, reach, start)])})

    if parts <= 2:
        return points.withColumn("entry", F.lit(float("-inf"))).groupBy("entry").applyInArrow(kept, "x double")

    dealt = settle(points.repartitionByRange(parts, "x").withColumn("_part", F.spark_partition_id().cast("bigint")), "cover-parts")
    widest = dealt.agg(F.max("reach")).first()[0]

    def leaving(table: pa.Table) -> pa.Table:
        """Where the walk leaves the part, from each value it may be entered at: those within the widest reach of the first, and the next."""
        x, reach = ascending(table)
        here = np.arange(len(x))
        jump = np.maximum(np.searchsorted(x, x + reach), here + 1)
        last = np.where(jump < len(x), np.minimum(jump, len(x) - 1), here)  # the last value of a walk stays
        while (last[last] != last).any():
            last = last[last]
        entries = here[: np.searchsorted(x, x[0] + widest) + 1]
        return pa.table({"_part": table["_part"][: len(entries)], "x": x[entries], "ahead": np.maximum(x[last] + reach[last], np.nextafter(x[last], np.inf))[entries]})

    entries = settle(dealt.groupBy("_part").applyInArrow(leaving, "_part bigint, x double, ahead double"), "cover-entries")
    jumps = settle(next_values(entries.select("x", "ahead"), entries.select("x")).filter("y is not null"), "cover-jumps")
    marked = dealt.agg(F.min("x").alias("x"))
    while True:
        # both grow with the number of parts at most, but jumps with the values: no broadcast of them
        new = settle(jumps.join(F.broadcast(marked), "x").select(F.col("y").alias("x")).join(F.broadcast(marked), "x", "left_anti").distinct(), "cover-marked")
        if new.isEmpty():
            break
        marked = settle(marked.unionByName(new), "cover-marked")
        jumps = settle(jumps.join(jumps.select(F.col("x").alias("y"), F.col("y").alias("z")).hint("merge"), "y").select("x", F.col("z").alias("y")), "cover-jumps")
    entered = entries.join(F.broadcast(marked), "x", "left_semi").select("_part", F.col("x").alias("entry"))  # one for each part at most
    return dealt.join(F.broadcast(entered), "_part").groupBy("_part").applyInArrow(kept, "x double")
