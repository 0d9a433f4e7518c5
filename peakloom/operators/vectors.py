"""Tables of whole vectors (key, v): sums by key in Arrow batches, and blocks of rows that meet the vectors they need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds before it hands partial sums on.
HELD = 1 << 22


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), pa.float64()))


def summed(keys: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys, in order of first appearance, and the sums of their rows."""
    coded = keys.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return coded.dictionary, np.add.reduceat(rows[order], first, axis=0) if len(first) else rows


def vector_sums(df: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """(key, vector): sums of whole vectors by key, the null key too; rows without a vector take no part.

    Tasks sum what they read, HELD numbers at a time, so a key that many rows have is a few rows in the shuffle; partial sums
    then come sorted by key and are added up as a stream.
    """
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, `{vector}` array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = None, None
        for b in batches:
            if not len(b):
                continue
            own, sums = summed(b[key], matrix(b[vector]))
            keys, rows = (own, sums) if keys is None else summed(pa.concat_arrays([keys, own]), np.concatenate([rows, sums]))
            if rows.size > HELD:
                yield pa.RecordBatch.from_arrays([keys, arrays(rows)], [key, vector])
                keys = rows = None
        if keys is not None:
            yield pa.RecordBatch.from_arrays([keys, arrays(rows)], [key, vector])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = None, None  # of the key that may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            own, found = b[key], matrix(b[vector])
            if keys is not None:
                own, found = pa.concat_arrays([keys, own]), np.concatenate([rows, found])
            own, found = summed(own, found)
            if len(own) > 1:
                yield pa.RecordBatch.from_arrays([own[:-1], arrays(found[:-1])], [key, vector])
            keys, rows = own[len(own) - 1 :], found[-1:]
        if keys is not None:
            yield pa.RecordBatch.from_arrays([keys, arrays(rows)], [key, vector])

    known = df.select(key, vector).filter(F.col(vector).isNotNull())
    return known.mapInArrow(partial, kind).repartition(key).sortWithinPartitions(key).mapInArrow(merged, kind)


def meet(rows: DataFrame, table: DataFrame, on: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `work` makes of each block of rows (block, ...) and the table's vectors (on, v) that the block names in `on`.

    A block fetches each vector once, however many of its rows name it, and blocks are bounded by whoever dealt them; the table may have any
    size, as it is joined in a shuffle.
    """
    needs = rows.select("block", on).distinct()
    fetched = needs.join(table.select(on, "v").hint("merge"), on).select(F.col("block").alias("its_block"), F.col(on).alias(on), "v")
    return rows.groupBy("block").cogroup(fetched.groupBy("its_block")).applyInArrow(work, schema)


def places(wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in `known` of each number wanted, and whether it is there."""
    order = np.argsort(known, kind="stable")
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = order[np.minimum(np.searchsorted(known, wanted, sorter=order), len(known) - 1)]
    return at, known[at] == wanted


#: Rows of one block, about, and how many of them are weighed at a time.
BLOCK_ROWS, AT_ONCE = 100_000, 8192


def weighted_means(cells: DataFrame, vectors: DataFrame, power: float = 0.5) -> DataFrame:
    """(doc, v): vectors (word, v) averaged over cells (doc, word, w) with weights w**power; words without a vector take no part.

    Blocks of whole documents fetch the vectors of their distinct words and hand on one vector a document. A document of more than BLOCK_ROWS
    cells is dealt over several blocks, whose sums are added up.
    """
    kind = f"doc {cells.schema['doc'].dataType.simpleString()}, v array<double>"
    sizes = cells.groupBy("doc").agg(F.count("*").alias("cells"))
    total, most = sizes.agg(F.sum("cells"), F.max("cells")).first()
    blocks = max(1, -(-(total or 0) // BLOCK_ROWS))
    part = F.lit(0)
    split = (most or 0) > BLOCK_ROWS
    if split:
        large = sizes.filter(F.col("cells") > BLOCK_ROWS).select(F.col("doc").alias("_doc"), F.ceil(F.col("cells") / BLOCK_ROWS).alias("_parts"))
        cells = cells.join(large.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")), "left")
        part = F.coalesce(F.pmod(F.xxhash64("word"), F.col("_parts")), F.lit(0))
    rows = cells.select("doc", "word", F.pow("w", F.lit(float(power))).alias("w"), F.pmod(F.xxhash64("doc", part), F.lit(blocks)).alias("block"))

    def work(own: pa.Table, fetched: pa.Table) -> pa.Table:
        coded = own["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        found = pc.index_in(own["word"], value_set=fetched["word"].combine_chunks()).combine_chunks()
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at, weight, owner = found.drop_null().to_numpy(), own["w"].to_numpy()[known], coded.indices.to_numpy()[known]
        v = matrix(fetched["v"])
        sums = np.zeros((len(coded.dictionary), (v.shape[1] if len(v) else 0) + 1))
        order = np.argsort(owner, kind="stable")
        for first in range(0, len(order), AT_ONCE):
            chosen = order[first : first + AT_ONCE]
            starts = np.flatnonzero(np.diff(owner[chosen], prepend=-1))
            w = weight[chosen]
            sums[owner[chosen][starts]] += np.add.reduceat(np.column_stack([v[at[chosen]] * w[:, None], w]), starts, axis=0)
        there = np.bincount(owner, minlength=len(sums)) > 0
        return pa.table({"doc": coded.dictionary.filter(pa.array(there)), "v": arrays(sums[there])})

    sums = meet(rows, vectors, "word", work, kind)
    sums = vector_sums(sums, "doc") if split else sums
    return sums.select("doc", F.transform(F.slice("v", F.lit(1), F.size("v") - 1), lambda x: x / F.element_at("v", -1)).alias("v"))
