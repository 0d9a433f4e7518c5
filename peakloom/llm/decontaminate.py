"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For every word length that an item has, each window of that many words of a document is compared with the items of that
length; a document with fewer words is one window, all of it. A window gets a 64-bit SimHash of its 5-word shingles; fingerprints are cut into BLOCKS blocks, and an item is
a candidate if any block is equal, which by the pigeonhole principle finds all fingerprints within BLOCKS - 1 bits.
Candidates within that radius are verified by the exact weighted-shingle similarity: sum of least over sum of greatest
shingle counts, at least `threshold`.

Windows that cannot reach the threshold are passed over before they are fingerprinted: similarity s needs a share
of s of the window's shingles to be some item's shingles, which one running sum decides. The items are a stated
query set; they go to the workers in blocks of at most ITEM_BYTES of text, each a broadcast of about four times that and a pass
over the documents.

All fingerprints within the radius are found. That a pair of similarity 0.8 lies within it is no theorem: over 3,000 random pairs of
items of 20 to 80 words and windows with similarity 0.8 or more the test measures a recall of 1.

Defined cases: words are lower-cased; an item of 1 to 4 words has one shingle, all its words; an empty or null item and
an empty or null text match nothing; repeated documents are reported each; an item that is listed twice is reported twice; of
windows that tie the first is reported, then the shortest; an empty table on either side gives no leak. Ids may be of any type and null.
Other columns of the documents are carried by `clean`, whatever their names, and ignored by `leaks`. A long text is held whole with some
40 bytes a word; fingerprints are made of SLAB shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import textops as T
from .common import documents

BITS = 64
BLOCKS = 21
ITEM_BYTES = 8 << 20  # of text: some four times as much is broadcast at a time
SLAB = 1 << 15  # shingles whose bits are summed at a time, besides one item's length
_CUTS = np.linspace(0, BITS, BLOCKS + 1).astype(int)


def fingerprints(cumulated: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """SimHashes of the shingles low..high; cumulated: running sums of each bit's +1 and -1."""
    return np.packbits(cumulated[high] - cumulated[low] > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def block_keys(prints: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key for each fingerprint and block, of the length, the block's number and its bits."""
    parts = [(prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True)]
    keys = np.stack(parts, axis=1) + (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(8))[None, :]
    return keys + (lengths.astype(np.uint64) << np.uint64(16))[:, None]


class Items:
    """Items of a benchmark: shingles, fingerprints and the multi-index over them."""

    def __init__(self, ids: list, texts: list[str | None], n: int = 5) -> None:
        self.n = n
        words = next(T.chunks(pa.array(texts, pa.string()), lower=True, size=1 << 62), None)
        self.ids, self.shingles, self.lengths = [], [], []
        for k, item in enumerate(ids if words is not None else []):
            hashes = words.hashes[words.bounds[k] : words.bounds[k + 1]]
            if len(hashes):
                self.ids.append(item)
                self.lengths.append(len(hashes))
                self.shingles.append(T.gram_hashes(hashes, min(n, len(hashes))))
        self.distinct = [np.unique(s, return_counts=True) for s in self.shingles]
        self.sizes = sorted(set(self.lengths))
        self.known = np.unique(np.concatenate(self.shingles)) if self.ids else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        self.prints = np.array([fingerprints(bit_sums(s), np.array([0]), np.array([len(s)]))[0] for s in self.shingles], dtype=np.uint64)
        keys = block_keys(self.prints, np.array(self.lengths)) if self.ids else np.zeros((0, BLOCKS), np.uint64)
        order = np.argsort(keys.reshape(-1), kind="stable")
        self.keys, self.owners = keys.reshape(-1)[order], order // BLOCKS

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        out = self.maybe[shingles & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(out)
        out[at] = np.isin(shingles[at], self.known)
        return out

    def candidates(self, prints: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one length whose fingerprints differ in less than BLOCKS bits."""
        keys = block_keys(prints, lengths).reshape(-1)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        window = np.repeat(np.arange(len(keys)) // BLOCKS, n)
        item = self.owners[np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] if n.sum() else np.zeros(0, int)
        pairs = np.unique(window * max(len(self.ids), 1) + item)
        window, item = np.divmod(pairs, max(len(self.ids), 1))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) < BLOCKS
        return window[near], item[near]

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        """Sum of least over sum of greatest shingle counts."""
        own, n = np.unique(shingles, return_counts=True)
        other, m = self.distinct[item]
        at = np.minimum(np.searchsorted(other, own), len(other) - 1)
        least = int(np.minimum(n, m[at])[other[at] == own].sum())
        return least / (len(shingles) + len(self.shingles[item]) - least)

    def find(self, hashes: np.ndarray, hit: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, start, length, similarity): the best window for each item in a text of these word hashes."""
        starts, sizes = [], []
        total = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            if size >= self.n and size <= len(hashes):
                n = size - self.n + 1
                at = np.flatnonzero(total[n:] - total[:-n] >= threshold * n - 1e-9)
                starts.append(at)
                sizes.append(np.full(len(at), size))
            elif size >= self.n:
                own, n = len(hashes) - self.n + 1, size - self.n + 1
                if own > 0 and total[-1] >= threshold * (own + n) / (1 + threshold) - 1e-9:
                    starts.append(np.array([0]))
                    sizes.append(np.array([size]))
            elif size <= len(hashes):
                grams = T.gram_hashes(hashes, size)
                for k, item_size in enumerate(self.lengths):
                    if item_size == size and len(at := np.flatnonzero(grams == self.shingles[k][0])):
                        best[k] = (1.0, int(at[0]), size)
        if starts and sum(map(len, starts)):
            start, size = np.concatenate(starts), np.concatenate(sizes)
            order = np.argsort(start, kind="stable")
            start, size = start[order], size[order]
            span = np.minimum(size, len(hashes))
            shingles = T.gram_hashes(hashes, self.n)
            at = 0
            while at < len(start):
                part = slice(at, int(np.searchsorted(start, start[at] + SLAB)))
                first, last = int(start[at]), int((start[part] + span[part]).max()) - self.n + 1
                prints = fingerprints(bit_sums(shingles[first:last]), start[part] - first, start[part] - first + span[part] - self.n + 1)
                for w, k in zip(*(x.tolist() for x in self.candidates(prints, size[part])), strict=True):
                    begin, n = int(start[at + w]), int(span[at + w])
                    s = self.similarity(shingles[begin : begin + n - self.n + 1], k)
                    if s >= threshold - 1e-9 and (k not in best or (-s, begin, n) < (-best[k][0], *best[k][1:])):
                        best[k] = (s, begin, n)
                at = part.stop
        return [(self.ids[k], at, n, s) for k, (s, at, n) in sorted(best.items())]

    def scan(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """(row, leaks) of the rows that have any."""
        short = any(n < self.n for n in self.sizes)
        least = min((n - self.n + 1 for n in self.sizes if n >= self.n), default=1 << 60)
        for w in T.chunks(column, lower=True):
            grams = T.gram_hashes(w.hashes, self.n)
            hit = np.zeros(len(w.hashes), dtype=bool)
            hit[: len(grams)] = self.hits(grams)
            total = np.concatenate([[0], np.cumsum(hit)])
            count = total[w.bounds[1:]] - total[w.bounds[:-1]]
            for d in np.flatnonzero((w.counts > 0) & (short | (count >= threshold * least - 1e-9))):
                a, b = w.bounds[d], w.bounds[d + 1]
                if found := self.find(w.hashes[a:b], hit[a : max(a, b - self.n + 1)], threshold):
                    yield w.first + int(d), found


def item_blocks(benchmark: DataFrame, n: int, limit: int = ITEM_BYTES) -> list[Broadcast]:
    """The query set, cut into blocks of at most `limit` bytes of text (a longer item is one for itself), each broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    count = max(1, -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]) // limit))
    out = []
    for k in range(count):
        table = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toArrow()
        out.append(spark.sparkContext.broadcast(Items(table["item_id"].to_pylist(), table["text"].to_pylist(), n)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): each document's best window for each item it holds; ids keep their types."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType), StructField("start", LongType()), StructField("n_words", LongType()), StructField("similarity", DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    out = None
    for shared in item_blocks(benchmark, n):

        def rows(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(b["doc_id"][row].as_py(), *leak) for row, leak_list in shared.value.scan(b["text"], threshold) for leak in leak_list]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)], schema.names)

        part = docs.select("doc_id", "text").mapInArrow(rows, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold an item; no row moves."""
    place = docs.columns.index("text")
    for shared in item_blocks(benchmark, n):

        def rows(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), dtype=bool)
                keep[[row for row, _ in shared.value.scan(b.column(place), threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
