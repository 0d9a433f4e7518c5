"""Embeddings, fingerprints and their similarities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import weighted_means

BLOCK = 4096  # rows of one side of a block of pairs
QUERY_BLOCK = 1024
PAIRS_AT_ONCE = 1 << 19  # of which the kernel's arrays are in a task at a time
SHARED_BYTES = 64 << 20  # a side up to this size goes to all tasks
DENSE_BITS = 1 << 16  # fingerprints of more positions are compared as sets


def unit(v: Column) -> Column:
    """A vector of length 1; zeros stay, NaN counts as 0."""
    clean = F.transform(v, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731 - a name for a value, which is then not computed for each element
    scaled = lambda c, n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)
    return once(clean, lambda c: once(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: scaled(c, n)))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, as `unit` makes them."""
    clean = np.where(np.isnan(rows), 0.0, rows)
    norm = np.sqrt((clean * clean).sum(axis=1, keepdims=True))
    return np.divide(clean, norm, out=clean, where=norm > 0)


Picked = tuple[np.ndarray, np.ndarray, np.ndarray]


def matched(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Picked], names: tuple[str, str, str], width: int, counts: tuple[int, int], cells: list[tuple[int, int]] | None = None) -> DataFrame:
    """What `kernel` picks of each block of pairs: left and right (key, part, data), data of `width` bytes, as (left key, right key, score).

    kernel gets two blocks' keys and bytes and returns rows, columns and scores. If the smaller side takes up to SHARED_BYTES, by the
    numbers of rows in counts, it goes to all tasks, sorted by part, and the other side is read where it lies, BLOCK rows of ascending
    part at a time. Else both sides are dealt into `cells`, pairs of parts that may match (all of them by default), each a group of two parts,
    and a row is copied once for each part that its own may match.
    """
    spark, kinds = left.sparkSession, f"{names[0]} bigint, {names[1]} bigint, {names[2]} double"
    small = 0 if counts[0] < counts[1] else 1

    def batch(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        several = max(1, PAIRS_AT_ONCE // max(1, len(b[0])))
        for start in range(0, len(a[0]), several):
            keys, data = (x[start : start + several] for x in a)
            row, column, score = kernel(keys, data, *b)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(b[0][column]), pa.array(score.astype(float))], list(names))

    if counts[small] * (width + 16) <= SHARED_BYTES:
        partners = None if cells is None else _partners(cells, small)
        shared = spark.sparkContext.broadcast(_sorted(((left, right)[small]).toArrow(), width))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, parts, data = shared.value
            for b in batches:
                own = _sorted(pa.Table.from_batches([b]), width)
                for first in range(0, len(own[0]), QUERY_BLOCK):
                    at = slice(first, first + QUERY_BLOCK)
                    low, high = (0, len(keys)) if partners is None else _stretch(parts, own[1][at], partners)
                    for start in range(low, high, BLOCK):
                        other = slice(start, min(start + BLOCK, high))
                        mine, theirs = (own[0][at], own[2][at]), (keys[other], data[other])
                        yield from batch(theirs, mine) if small == 0 else batch(mine, theirs)

        return (left, right)[1 - small].select("key", "part", "data").mapInArrow(rows, kinds)

    every = [(r["a"], r["b"]) for r in left.select(F.col("part").alias("a")).distinct().crossJoin(right.select(F.col("part").alias("b")).distinct()).collect()] if cells is None else cells  # parts, not rows
    table = spark.createDataFrame(every, "a bigint, b bigint")
    dealt = [side.join(F.broadcast(table), F.col("part") == F.col(own)).select("key", "data", "a", "b", F.lit(k).alias("side")) for k, (side, own) in enumerate(((left, "a"), (right, "b")))]

    def block(group: pa.Table) -> pa.Table:
        a, b = (_sorted(group.filter(pa.compute.equal(group["side"], k)).append_column("part", pa.array(np.zeros(n, np.int64))), width) for k, n in enumerate(np.bincount(group["side"].to_numpy(), minlength=2)))
        found = batch((a[0], a[2]), (b[0], b[2])) if len(a[0]) and len(b[0]) else ()
        return pa.Table.from_batches(found, pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True))))

    return dealt[0].unionByName(dealt[1]).groupBy("a", "b").applyInArrow(block, kinds)


def _sorted(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, parts and rows of bytes, by part."""
    parts = table["part"].to_numpy()
    order = np.argsort(parts, kind="stable")
    data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8).reshape(len(parts), width)
    return table["key"].to_numpy()[order], parts[order], data[order]


def _partners(cells: list[tuple[int, int]], side: int) -> dict[int, tuple[int, int]]:
    """For each part of the other side the least and the greatest part of this one that it may match."""
    out: dict[int, tuple[int, int]] = {}
    for pair in cells:
        own, other = pair[side], pair[1 - side]
        low, high = out.get(other, (own, own))
        out[other] = (min(low, own), max(high, own))
    return out


def _stretch(parts: np.ndarray, asked: np.ndarray, partners: dict[int, tuple[int, int]]) -> tuple[int, int]:
    found = [partners[p] for p in np.unique(asked).tolist() if p in partners]
    if not found:
        return 0, 0
    return int(np.searchsorted(parts, min(f[0] for f in found))), int(np.searchsorted(parts, max(f[1] for f in found), side="right"))


def packed(vectors: DataFrame, key: str, width: int, rows: int) -> DataFrame:
    """(key, part, data): unit vectors as bytes, dealt by hash into parts of about BLOCK rows."""
    parts = max(1, -(-rows // BLOCK))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = units(b["v"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)) if len(b) else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([b["key"], b["part"], pa.array([x.tobytes() for x in v], pa.binary())], ["key", "part", "data"])

    own = F.col(key).cast("bigint")
    return vectors.select(own.alias("key"), F.pmod(F.xxhash64(own, F.lit(7)), F.lit(parts)).alias("part"), F.col("v").cast("array<double>").alias("v")).mapInArrow(made, "key bigint, part bigint, data binary")


def _cosines(library: DataFrame, queries: DataFrame, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query, id, score) of what `pick` takes of each block of exact products, queries (query, v) by library (id, v)."""
    width = max((r[0] for side in (library, queries) for r in side.select(F.size("v")).limit(1).collect()), default=1)

    def kernel(asked: np.ndarray, q: np.ndarray, keys: np.ndarray, x: np.ndarray) -> Picked:
        score = q.view(np.float64) @ x.view(np.float64).T
        row, column = pick(score)
        return row, column, score[row, column]

    counts = queries.count(), library.count()
    return matched(packed(queries, "query", width, counts[0]), packed(library, "id", width, counts[1]), kernel, ("query", "id", "score"), 8 * width, counts)


def cosine_top(library: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k rows of library (id, v) with the largest cosine for each of queries (query, v), ties to the smaller id."""

    def pick(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(k, score.shape[1])
        least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        return np.nonzero(score >= least[:, None] - 1e-12)  # those that tie too: the ranking settles them

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return _cosines(library, queries, pick).withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine_pairs(library: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query, id, score) of all pairs with a cosine of at least `least`."""
    return _cosines(library, queries, lambda score: np.nonzero(score >= least))


def unique_hits(hits: DataFrame, molecules: DataFrame, n: int) -> DataFrame:
    """The first n molecules of each query in order of rank: hits joined with (id, molecule), one for each molecule."""
    named = hits.join(molecules, "id").filter("molecule is not null")
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("query", "molecule").orderBy("rank"))).filter("nth = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("place") <= n).drop("nth")


def bits(v: Column) -> Column:
    """A fingerprint's set positions."""
    return F.filter(F.transform(v, lambda x, k: F.when(x > 0, k)), lambda x: x.isNotNull())


def tanimoto(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(query: Column, other: Column) -> Column:
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)) / F.size(query)).otherwise(F.lit(0.0))


def by_rarity(sets: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """(key, set): each set's positions with the rarest first; ranks (pos, n) of all sets together."""
    cells = sets.select(key, F.explode("set").alias("pos")).join(ranks, "pos")
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "pos"))), lambda x: x["pos"]).alias("set"))


def size_parts(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each size of a fingerprint, from the number of rows that have it: its first part and its number of parts.

    Parts go by size and have about BLOCK rows: rare sizes that follow each other share one, a frequent size is dealt over several.
    """
    out, part, rows = {}, 0, 0
    for size in sorted(counts):
        if rows and rows + counts[size] > BLOCK:
            part, rows = part + 1, 0
        several = -(-counts[size] // BLOCK)
        out[size] = (part, several)
        part, rows = (part + several, 0) if several > 1 else (part, rows + counts[size])
    return out


def bit_rows(sets: DataFrame, key: str, width: int) -> tuple[DataFrame, dict[int, tuple[int, int]], int]:
    """((key, part, data), sizes of each part as (least, greatest), rows): sets as rows of bits, in parts by size."""
    counts = {r["size"]: r["rows"] for r in sets.groupBy(F.size("set").alias("size")).agg(F.count("*").alias("rows")).collect()}  # width + 1 at most
    places = size_parts(counts)
    spans: dict[int, tuple[int, int]] = {}
    for size, (part, several) in places.items():
        for p in range(part, part + several):
            spans[p] = (min(size, spans.get(p, (size, 0))[0]), max(size, spans.get(p, (0, size))[1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["set"].value_lengths().fill_null(0).to_numpy()
            flags = np.zeros((len(b), width), dtype=np.uint8)
            flags[np.repeat(np.arange(len(b)), sizes), b["set"].flatten().to_numpy()] = 1
            first, several = (np.array([places[n][k] for n in sizes.tolist()], dtype=np.int64) for k in (0, 1))
            part = first + b["key"].to_numpy() % np.maximum(several, 1)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(part), pa.array([x.tobytes() for x in np.packbits(flags, axis=1)], pa.binary())], ["key", "part", "data"])

    return sets.select(F.col(key).cast("bigint").alias("key"), "set").mapInArrow(rows, "key bigint, part bigint, data binary"), spans, sum(counts.values())


def tanimotos(least: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Picked]:
    """Pairs of rows of bits with a Tanimoto similarity of at least `least`, by counting common bits a word at a time."""

    def kernel(keys_a: np.ndarray, a: np.ndarray, keys_b: np.ndarray, b: np.ndarray) -> Picked:
        a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
        both = np.zeros((len(a), len(b)), dtype=np.int32)
        for k in range(a.shape[1]):
            both += np.bitwise_count(a[:, k, None] & b[None, :, k])
        union = np.bitwise_count(a).sum(axis=1, dtype=np.int32)[:, None] + np.bitwise_count(b).sum(axis=1, dtype=np.int32) - both
        score = np.where(union > 0, both / np.maximum(union, 1), 0.0)
        row, column = np.nonzero(score >= least)
        return row, column, score[row, column]

    return kernel


def screen(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): pairs of left (a, set) and right (b, set) with Tanimoto similarity of at least `least`, for whole-number keys.

    Fingerprints of up to DENSE_BITS positions become rows of bits, in blocks of like size: a pair of blocks is left out where the smaller
    size is below `least` times the larger one for all their rows, as a pair's similarity is at most that ratio. Wider ones are compared as sets.
    """
    top = left.select(F.array_max("set").alias("top")).unionAll(right.select(F.array_max("set"))).agg(F.max("top")).first()[0]
    if top is not None and top >= DENSE_BITS:
        return screen_sets(left, right, least)
    width = -(-((top or 0) + 1) // 64) * 64
    (a, spans_a, n_a), (b, spans_b, n_b) = bit_rows(left, "a", width), bit_rows(right, "b", width)
    cells = [(i, j) for i, (low, high) in spans_a.items() for j, (below, above) in spans_b.items() if high >= least * below and above >= least * low]
    return matched(a, b, tanimotos(least), ("a", "b", "score"), width // 8, (n_a, n_b), cells)


def screen_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): pairs of left (a, set) and right (b, set) with Tanimoto similarity of at least `least`.

    Sets meet on their rarest common positions: in one order of all positions, rarest first, a pair reaches s only if the
    first n - ceil(s * n) + 1 of either set share a position, so only these are joined. Adaptive execution splits positions that many have.
    """
    prefix = lambda s: F.slice(s, 1, F.greatest(F.size(s) - F.ceil(F.size(s) * least).cast("int") + 1, F.lit(1)))
    ranks = left.select(F.explode("set").alias("pos")).unionAll(right.select(F.explode("set").alias("pos"))).groupBy("pos").agg(F.count("*").alias("n"))
    a = by_rarity(left, "a", ranks).withColumnRenamed("set", "sa")
    b = by_rarity(right, "b", ranks).withColumnRenamed("set", "sb")
    a, b = a.withColumn("pa", prefix(F.col("sa"))), b.withColumn("pb", prefix(F.col("sb")))
    pairs = a.withColumn("k", F.explode("pa")).join(b.withColumn("k", F.explode("pb")), "k")
    pairs = pairs.filter(F.element_at(F.array_intersect("pa", "pb"), 1) == F.col("k"))  # once, at the rarest common position
    sized = pairs.filter((F.size("sa") >= F.size("sb") * least) & (F.size("sb") >= F.size("sa") * least))
    return sized.select("a", "b", tanimoto(F.col("sa"), F.col("sb")).alias("score")).filter(F.col("score") >= least)


def consensus(prints: DataFrame, key: str, least: float) -> DataFrame:
    """(key, pos, bit): whether at least the share `least` of a group's fingerprints has the position set."""
    cells = prints.select(key, F.posexplode("bits").alias("pos", "b"))
    return cells.groupBy(key, "pos").agg((F.avg("b") >= least).cast("int").alias("bit"))


def masked(motifs: DataFrame, mask: float = -1.0) -> DataFrame:
    """(motif, left_out, features): every leave-one-out variant, with the mask put first."""
    each = motifs.select("motif", "features", F.posexplode("features").alias("left_out", "_f"))
    return each.select("motif", "left_out", F.concat(F.array(F.lit(mask)), F.filter("features", lambda x, k: k != F.col("left_out"))).alias("features"))


def mean_embedding(cells: DataFrame, vectors: DataFrame, power: float = 0.5) -> DataFrame:
    """(doc, pos, value): word vectors (word, v) averaged with weights n**power over cells (doc, word, n)."""
    return weighted_means(cells.withColumnRenamed("n", "w"), vectors, power).select("doc", F.posexplode("v").alias("pos", "value"))
