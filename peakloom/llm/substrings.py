"""Substring dedup by relative Lempel-Ziv parsing of word sequences.

The reference is the first place of every distinct `window`-word sequence of the corpus: least doc_id, then least word. A
document is factored greedily against what the reference holds of documents with a smaller id. As a sequence stands in the
reference once, the longest match from a word on is found by going on side by side for as long as the next window
stands next in the same reference document. A factor names its start, length, reference document and the word there. Factors
have at least `window` words and don't overlap; windows that cross the end of one and are in the reference elsewhere are
bridges, so no repeat is lost where the reference changes. Both are duplicate spans.

The index is dealt into blocks by window hash (the partitions of a shuffle), and every document asks all blocks in which
it has a window. It is built in two steps, so that the windows of unrepeated text are never shuffled:

1. anchors: in every window the least 5-gram hash is chosen, so equal windows have equal anchors; about a fifth of the
   words start one. Only anchors found in two different contents can belong to repeated windows.
2. windows over such anchors are indexed with the first place that has them.

Counts use partial aggregation and keys join against unique keys, so adaptive execution can split common passages; equal
contents are parsed once. Windows are compared by 96 bits of hash over their words' 64-bit hashes.

Defined cases: null and empty texts have no words; a text of fewer than `window` words keeps all; rows with a null
doc_id neither lose words nor serve as reference; rows that share a doc_id don't serve each other, and a reference to such an id is
a place in one of its rows; a repeated row is treated like the first; of equal windows in documents of one id the earliest is the
reference; an empty table gives an empty result; other columns are not read. A text is held whole, with 24 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import discard, documents, settle, shuffled_join

ANCHOR = 5


def window_anchors(w: T.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their texts' bounds, and each window's anchor: the least hash of its ANCHOR-grams."""
    starts, bounds = T.gram_starts(w.bounds, window)
    grams = T.gram_hashes(w.hashes, min(ANCHOR, window))
    n = max(len(w.hashes) - window + 1, 0)
    least = grams[:n].copy()
    for j in range(1, window - min(ANCHOR, window) + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return starts, bounds, least[starts] if len(starts) else least[:0]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(content, anchor): the distinct anchors of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = b["content"].to_numpy(zero_copy_only=False)
            for w in T.chunks(b["text"]):
                starts, bounds, found = window_anchors(w, window)
                owner = np.repeat(np.arange(w.n), np.diff(bounds))
                change = np.ones(len(found), dtype=bool)
                change[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(content[w.first + owner[change]]), pa.array(found[change].view(np.int64))], ["content", "anchor"])

    return docs.select("content", "text").mapInArrow(rows, "content bigint, anchor bigint")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, content, pos, piece, twin, fresh): the windows whose anchor is among their row's `hot` ones: place, 96 bits of hash, and whether the row has them there for the first time."""
    fields = ["doc_id", "content", "pos", "piece", "twin", "fresh"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, content, hot = b["doc_id"].to_numpy(zero_copy_only=False), b["content"].to_numpy(zero_copy_only=False), b["hot"]
            for w in T.chunks(b["text"]):
                starts, bounds, found = window_anchors(w, window)
                keep = np.zeros(len(starts), dtype=bool)
                for d in range(w.n):
                    if bounds[d] < bounds[d + 1]:
                        keep[bounds[d] : bounds[d + 1]] = np.isin(found[bounds[d] : bounds[d + 1]].view(np.int64), hot[w.first + d].values.to_numpy())
                owner = np.repeat(np.arange(w.n), np.diff(bounds))[keep]
                at = starts[keep]
                piece = T.gram_hashes(w.hashes, window)[at].view(np.int64)
                twin = (T.gram_hashes(T.mix64(w.hashes + np.uint64(1)), window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((piece, owner))  # stable: equal windows stay in order of place
                fresh = np.ones(len(at), dtype=bool)
                fresh[order[1:]] = (piece[order][1:] != piece[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.first + owner]), pa.array(content[w.first + owner]), pa.array((at - w.bounds[owner]).astype(np.int32)), pa.array(piece), pa.array(twin), pa.array(fresh)], fields)

    return docs.select("doc_id", "content", "hot", "text").mapInArrow(rows, "doc_id bigint, content bigint, pos int, piece bigint, twin int, fresh boolean")


def greedy(pos: np.ndarray, ref: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int, bool]]:
    """Relative Lempel-Ziv factors of one text as (start, length, ref_doc, ref_pos, bridge), from its windows' places and those in the reference, by place.

    A factor begins at the first place not yet parsed whose window is in the reference, and goes on for as long as the next
    window stands next in the same document of the reference. The next factor begins behind it at the earliest. Windows across the end
    of a factor that are in the reference elsewhere are bridges.
    """
    if not len(pos):
        return []
    breaks = np.ones(len(pos), dtype=bool)
    breaks[1:] = (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(breaks)
    out, free = [], -1
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(pos)], strict=True):
        # windows s..e-1 stand in a row in one reference: those before `free` cross the end of the factor before them
        begin = s + min(max(free - int(pos[s]), 0), e - s)
        if begin > s:
            out.append((int(pos[s]), begin - s + window - 1, int(ref[s]), int(at[s]), True))
        if begin < e:
            free = int(pos[begin]) + e - begin + window - 1
            out.append((int(pos[begin]), e - begin + window - 1, int(ref[begin]), int(at[begin]), False))
    return out


FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_pos", pa.int32()), ("bridge", pa.bool_())])
FACTORS = "array<struct<start:int,length:int,ref_doc:bigint,ref_pos:int,bridge:boolean>>"


def parse(hits: DataFrame, window: int) -> DataFrame:
    """(doc_id, content, factors): the greedy parse of each text, from all its windows that are in the reference."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = b["hits"].offsets.to_numpy()
            columns = [b["hits"].values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                pos, ref, at = (x[s:e] for x in columns)
                order = np.lexsort((at, ref, pos))
                pos, ref, at = pos[order], ref[order], at[order]
                once = np.ones(len(pos), dtype=bool)  # repeated rows repeat their hits
                once[1:] = pos[1:] != pos[:-1]
                out.append([dict(zip(("start", "length", "ref_doc", "ref_pos", "bridge"), f, strict=True)) for f in greedy(pos[once], ref[once], at[once], window)])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["content"], pa.array(out, pa.list_(FACTOR))], ["doc_id", "content", "factors"])

    return hits.mapInArrow(rows, f"doc_id bigint, content bigint, factors {FACTORS}")


def factors(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, content, copy_of, factors) of the documents that have any duplicate span, from docs (doc_id, text, content, check).

    copy_of: the least doc_id with the same content, if it is smaller; then the whole text is one factor, and it is not parsed.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    same = settle(docs.groupBy("content", "check").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "rlz-same")
    copies = docs.select("doc_id", "content", "check").join(same.hint("merge"), ["content", "check"]).filter("doc_id > first").select("doc_id", "content", F.col("first").alias("copy_of")).distinct()

    found = settle(anchors(docs, window), "rlz-found")
    # settled, so that both sides of the joins below are plain shuffles, whose crowded keys adaptive execution splits
    hot = settle(found.groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high").select("anchor"), "rlz-hot")
    firsts = same.withColumnRenamed("check", "its_check")  # of two texts with one content hash but another check, neither is left out
    by_text = settle(found.join(hot.hint("merge"), "anchor").groupBy("content").agg(F.collect_set("anchor").alias("hot")).join(firsts.hint("merge"), "content", "left"), "rlz-anchors")
    discard(found, hot)
    hot_docs = shuffled_join(docs, by_text, ["content"], "inner").filter("first is null or check != its_check or doc_id = first")

    placed = settle(windows(hot_docs, window), "rlz-windows")
    discard(by_text)
    reference = placed.groupBy("piece", "twin").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("last"), F.min_by("pos", F.when(F.col("fresh"), F.col("doc_id"))).alias("ref_pos"))
    reference = settle(reference.filter("ref_doc < last").drop("last"), "rlz-reference")
    hits = placed.join(reference.hint("merge"), ["piece", "twin"]).filter("ref_doc < doc_id").groupBy("doc_id", "content").agg(F.collect_list(F.struct("pos", "ref_doc", "ref_pos")).alias("hits"))
    out = settle(parse(hits, window).join(copies.hint("merge"), ["doc_id", "content"], "full_outer"), "rlz-factors")
    discard(placed, reference, same)
    return out


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with content and check: 96 bits of hash that stand for the text."""
    return docs.withColumns({"content": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "check": F.hash(F.coalesce(F.col(text), F.lit("")))})


def strip(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_removed, kept (what is left, joined by one space) and factors."""
    docs = keyed(docs.select("doc_id", "text"))
    marked = shuffled_join(docs, factors(docs, window), ["doc_id", "content"], "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, spans = b["copy_of"].is_valid().to_numpy(zero_copy_only=False), b["factors"]
            for w in T.chunks(b["text"]):
                gone = np.zeros(len(w.hashes), dtype=bool)
                for d in range(w.n):
                    if w.bounds[d + 1] - w.bounds[d] >= window:
                        if whole[w.first + d]:
                            gone[w.bounds[d] : w.bounds[d + 1]] = True
                        elif spans[w.first + d].is_valid:
                            listed = spans[w.first + d].values
                            for s, n in zip(listed.field(0).to_pylist(), listed.field(1).to_pylist(), strict=True):
                                gone[w.bounds[d] + s : w.bounds[d] + s + n] = True
                kept = []
                raw = w.data.tobytes()
                for d in range(w.n):
                    at = slice(w.bounds[d], w.bounds[d + 1])
                    left = ~gone[at]
                    if left.all():
                        kept.append(b" ".join(raw[w.offsets[d] : w.offsets[d + 1]].split()).decode())
                    else:
                        kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[at][left].tolist(), w.ends[at][left].tolist(), strict=True)]).decode())
                removed = T.reduce_by_text(np.add, gone.astype(np.int64), w.bounds)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(w.first, w.n), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string()), spans.slice(w.first, w.n)], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return marked.select("doc_id", "text", "copy_of", "factors").mapInArrow(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept string, factors " + FACTORS)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, unnest(range(0, greatest(len(w) - 12, 0))) as pos from words),
pieces as (select s.doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + 13), ' ') as piece from starts s join words using (doc_id)),
hits as (select p.doc_id, pos from pieces p join (select piece, min(doc_id) as ref_doc from pieces group by piece) using (piece) where ref_doc < p.doc_id),
gone as (select doc_id, list(distinct idx) as idxs from (select doc_id, unnest(range(pos, pos + 13)) as idx from hits) group by doc_id),
kept as (select doc_id, w, coalesce(idxs, []) as idxs from words left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, len(idxs)::bigint as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(idxs, (i - 1)::bigint)), ' ')) as kept_sha256
from kept
"""
