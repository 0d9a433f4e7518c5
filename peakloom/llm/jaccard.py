"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Bands and rows are chosen for a target recall at the threshold. Documents with equal n-gram sets are one node. Nodes meet in
buckets (band, hash of its rows); a bucket with one node is dropped, as is one with the very members of another. What is
left is verified on full sets, in blocks of a bucket: a bucket of many nodes is cut into blocks by hash and every pair of
blocks is a group of its own, so no group is unbounded and no pair is emitted; a group returns for each node the number
of documents it is linked to and one edge of a spanning forest. A pair that shares several buckets counts in the least.

Defined cases: n-grams are of lower-cased words; a text of 1 to n - 1 words has one n-gram, all its words; empty and null
texts have none and are never linked; a row with a null doc_id is returned with a null class_id and no links; rows that
share a doc_id are documents of their own, and so are repeated rows, which are linked; a pair at the threshold itself is linked; a
class is named by its least doc_id; an empty table gives an empty result. Other columns are ignored by `links` and handed on by
`representatives`. A long text is held whole, with some 40 bytes a word. Sets and nodes are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, settle, shuffled_join
from .graph import components

BLOCK_NODES = 1024
BLOCK_GRAMS = 1 << 21
COLUMNS_AT_ONCE = 1024
ROWS_AT_ONCE = 128


def banding(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of `rows` rows that find a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct n-grams, ascending, and their bounds."""
    starts, bounds = T.gram_starts(w.bounds, n)
    grams = T.gram_hashes(w.hashes, n)
    parts = []
    for d in range(w.n):
        if bounds[d] < bounds[d + 1]:
            parts.append(np.unique(grams[starts[bounds[d]] : starts[bounds[d + 1] - 1] + 1]))
        elif count := int(w.bounds[d + 1] - w.bounds[d]):
            parts.append(T.gram_hashes(w.hashes[w.bounds[d] : w.bounds[d + 1]], count) ^ np.uint64(count))
        else:
            parts.append(grams[:0])
    return np.concatenate(parts) if parts else grams[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def node_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sums = T.reduce_by_text(np.add, T.mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
    sizes = np.diff(bounds).astype(np.uint64)
    out = T.mix64(sums + sizes * np.uint64(0x9E3779B97F4A7C15))
    out[sizes == 0] = 0
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(doc_id, node, n_grams, bands) of each document."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in T.chunks(b["text"], lower=True):
                grams, bounds = gram_sets(w, n)
                out = np.zeros((w.n, bands), dtype=np.uint64)
                for k in range(bands * rows):
                    least = T.reduce_by_text(np.minimum, grams * factor[k] + shift[k], bounds)
                    out[:, k // rows] = (out[:, k // rows] ^ T.mix64(least)) * np.uint64(0xD1342543DE82EF95)
                values = pa.ListArray.from_arrays(pa.array(np.arange(w.n + 1) * bands, pa.int32()), pa.array(out.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(w.first, w.n), pa.array(node_ids(grams, bounds)), pa.array(np.diff(bounds)), values], ["doc_id", "node", "n_grams", "bands"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id bigint, node bigint, n_grams bigint, bands array<bigint>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams) of docs (doc_id, text, node): only rows whose text has that node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b["node"].to_numpy()
            for w in T.chunks(b["text"], lower=True):
                grams, bounds = gram_sets(w, n)
                ids = node_ids(grams, bounds)
                keep = pa.array(ids == wanted[w.first : w.first + w.n])
                yield pa.RecordBatch.from_arrays([pa.array(ids), T.lists(grams.view(np.int64), bounds, pa.int64())], ["node", "grams"]).filter(keep)

    return docs.select("doc_id", "text", "node").mapInArrow(rows, "node bigint, grams array<bigint>")


def overlaps(grams: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of common grams, from one (gram, owner) entry for each member of each set; single floats hold such counts exactly."""
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else new
    column, owners = column[shared], owners[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), dtype=np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        x = np.zeros((n, min(COLUMNS_AT_ONCE, width - at)), dtype=np.float32)
        x[owners[low:high], column[low:high] - at] = 1
        out += x @ x.T
    return out


def alike(common: np.ndarray, counts: np.ndarray, threshold: float, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Pairs i < j of sets whose overlap reaches the threshold, some rows at a time; side: only pairs of different sides."""
    for at in range(0, len(counts), ROWS_AT_ONCE):
        mine = common[at : at + ROWS_AT_ONCE].astype(np.float64)
        union = counts[at : at + ROWS_AT_ONCE, None] + counts[None, :] - mine
        near = mine >= threshold * union - 1e-9
        near &= np.arange(at, at + len(mine))[:, None] < np.arange(len(counts))[None, :]
        if side is not None:
            near &= side[at : at + ROWS_AT_ONCE, None] != side[None, :]
        for i, j in np.argwhere(near).tolist():
            yield at + i, j


def verified(table: pa.Table, threshold: float) -> pa.Table:
    """A group's links: (node, near, links), near being the least node linked with it, over any path, in this group."""
    node, size, side = (table[c].to_numpy() for c in ("node", "size", "side"))
    grams = table["grams"].combine_chunks()
    counts = np.diff(grams.offsets.to_numpy())
    common = overlaps(grams.flatten().to_numpy(), np.repeat(np.arange(len(node)), counts), len(node))
    within = table["low"][0].as_py() == table["high"][0].as_py()
    bucket = table["bucket"][0].as_py()
    mine = [frozenset(x) for x in table["buckets"].to_pylist()]
    links, root = np.zeros(len(node), dtype=np.int64), list(range(len(node)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in alike(common, counts, threshold, None if within else side):
        if len(mine[i]) == 1 or len(mine[j]) == 1 or min(mine[i] & mine[j]) == bucket:
            links[i] += size[j]
            links[j] += size[i]
            a, b = top(i), top(j)
            if a != b:
                low, high = (a, b) if node[a] < node[b] else (b, a)
                root[high] = low
    keep = np.flatnonzero(links)
    return pa.table({"node": node[keep], "near": node[[top(int(i)) for i in keep]] if len(keep) else node[:0], "links": links[keep]})


def links(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, rows: int = 5) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id and n_links, the documents with similarity >= threshold to it."""
    bands = banding(threshold, recall, rows)
    signed = settle(signatures(docs, n, bands, rows), "jaccard-signatures")
    known = signed.filter("doc_id is not null and node <> 0")
    nodes = settle(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "jaccard-nodes")

    placed = nodes.select("node", "n_grams", F.posexplode("bands").alias("band", "value")).select("node", "n_grams", F.xxhash64("band", "value").alias("bucket"))
    held = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("n_grams").alias("n_grams"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("node").alias("low"))
        .filter("n > 1")
        .groupBy("n", "members", "low")
        .agg(F.min("bucket").alias("bucket"), F.first("n_grams").alias("n_grams"))
        .select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("n_grams") / BLOCK_GRAMS)).alias("blocks"))
    )
    members = placed.select("node", "bucket").join(held.hint("merge"), "bucket").groupBy("node").agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.struct("bucket", "blocks")).alias("held"))
    members = settle(members.join(nodes.select("node", "rep", "size").hint("merge"), "node"), "jaccard-members")

    wanted = members.select(F.col("rep").alias("doc_id"), "node")
    texts = shuffled_join(docs.select("doc_id", "text"), wanted, ["doc_id"], "inner")
    sets = full_sets(texts, n).groupBy("node").agg(F.first("grams").alias("grams"))
    block = F.pmod(F.xxhash64("node"), F.col("held.blocks"))
    grouped = (
        sets.join(members.select("node", "size", "buckets", F.explode("held").alias("held")).hint("merge"), "node")
        .select("node", "size", "buckets", "grams", F.col("held.bucket").alias("bucket"), block.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("held.blocks") - 1)).alias("other"))
        .select("node", "size", "buckets", "grams", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    )
    found = settle(grouped.groupBy("bucket", "low", "high").applyInArrow(lambda table: verified(table, threshold), "node bigint, near bigint, links bigint"), "jaccard-links")

    roots = components(found.select("node", "near"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots.hint("merge"), "node")
    named = nodes.select("node", "rep", "size").join(linked.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_node = settle(named.join(names.hint("merge"), "root").select("node", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-classes")
    out = shuffled_join(signed.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("node") != 0), F.col("node")).alias("node")), by_node, ["node"])
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def representatives(docs: DataFrame, **options: float) -> DataFrame:
    """docs without all but one document of each class: the one that names it, on one row."""
    found = settle(links(docs, **options), "jaccard-result").distinct()
    twice = settle(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "jaccard-twice")
    gone = settle(found.filter("doc_id <> class_id").select("doc_id").distinct(), "jaccard-gone")
    kept = shuffled_join(docs, gone, ["doc_id"], "left_anti")
    if twice.isEmpty():
        return kept
    # rows that share a doc_id: one of each content stays
    again = shuffled_join(kept, twice, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return shuffled_join(kept, twice, ["doc_id"], "left_anti").unionByName(again)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir))
