"""Token-ID output as length-delimited binary records with an offset index.

A record is framed as length (uint64), masked checksum of these 8 bytes (uint32), payload, masked checksum of the payload (uint32),
all little-endian. The checksum is zlib's CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data
that itself holds checksums stays useful. The payload is the bytes per id (uint8: 2 if the vocabulary fits, else 4) and
the ids. Documents are written in ascending doc_id order, a shard file for each partition of a range partitioning, and the
index (shard, offset, length, doc_id, ...) is a table of its own, so a reader can fetch records in any order.

A task writes under a name of its own attempt and returns it with its index rows; only returned names are ever
read, so a lost executor or a second attempt leaves at most an unread file. Files go to the shared folder through
pyarrow's file systems.

Defined cases: null and empty texts are one id, the end; null doc_ids come first; rows that share a doc_id are ordered by
content, repeated rows are records of their own; an empty table gives an empty index; a damaged record raises. Other columns are
ignored. A long text is held whole, with its ids and its record.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, fresh_dir, settle, shuffled_join

END_ID = 0
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
CACHE_PIECES = 1_000_000
RECENT_PIECES = 20_000
CHUNK_BYTES = 1 << 20
#: Texts of these characters only are split here, as their classes are the same in every Unicode version.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LETTER, DIGIT, OTHER, SPACE, STRANGE = range(5)


def _classes() -> np.ndarray:
    """The class of each code point up to U+024F."""
    out = np.full(0x250, OTHER, dtype=np.uint8)
    for k in range(0x250):
        if re.match(f"[{LETTERS}]", chr(k)):
            out[k] = LETTER
        elif re.match(f"[{DIGITS}]", chr(k)):
            out[k] = DIGIT
    out[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    out[:0x20][out[:0x20] == OTHER] = STRANGE
    out[0x7F:0xA1] = STRANGE
    return out


CLASSES = _classes()


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    length, crc = HEAD.unpack_from(record)
    payload = record[HEAD.size : HEAD.size + length]
    if crc != masked(record[:8]) or len(record) != HEAD.size + length + TAIL.size or TAIL.unpack_from(record, HEAD.size + length)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype="<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start in the bytes of texts, and which texts hold a character whose class is not known here.

    The usual pattern of byte-level BPE: contractions, runs of letters, of digits and of others with a space before them, and white
    space, of which the last one before something else is apart.
    """
    n = len(data)
    kind = CLASSES[np.minimum(data, 0x7F)]
    lead = np.flatnonzero((data >= 0xC0) & (np.arange(n) < n - 1))
    own = np.where(data[lead] < 0xE0, CLASSES[np.minimum(((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F), 0x24F)], STRANGE)
    own[(data[lead] >= 0xCA) | ((data[lead] == 0xC9) & (data[lead + 1] >= 0x90))] = STRANGE
    kind[lead] = kind[lead + 1] = own
    strange = np.concatenate([[0], np.cumsum(kind == STRANGE)])
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= begins[:n]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begins[1:n]) + 1  # what follows white space in a text
    start[after - 1] = True
    start[after] = data[after - 1] != 0x20
    mark = np.flatnonzero(start & (data == 0x27))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    text_end = offsets[np.searchsorted(offsets, mark, side="right")] if len(mark) else mark
    first, second = padded[mark + 1], padded[mark + 2]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8)) & (mark + 1 < text_end)
    two = (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))) & (mark + 2 < text_end)
    start = np.concatenate([start, np.ones(3, bool)])
    for chosen, size in ((one, 2), (two, 3)):
        at = mark[chosen]
        start[at + 1] = False
        start[at + size] = True
    return np.flatnonzero(start[:n]), strange[offsets[1:]] > strange[offsets[:-1]]


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes starts..ends, which follow each other."""
    out = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + T.HASH_BYTES, side="right")))
        at, sizes = starts[first:last] - low, ends[first:last] - starts[first:last]
        weights = T._BYTE_HASH[data[low : ends[last - 1]]]
        weights *= T.powers(int(sizes.max()))[np.arange(len(weights)) - np.repeat(at, sizes)]
        out[first:last] = np.add.reduceat(weights, at) + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        first = last
    return T.mix64(out)


class Known:
    """Ids of pieces by hash: keys ascending, places and numbers of ids in one pool."""

    def __init__(self, kind: str) -> None:
        self.keys, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
        order = np.argsort(keys)
        self.keys, self.at, self.n, self.pool = keys[order], at[order], np.concatenate([self.n, n])[order], np.concatenate([self.pool, ids])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones; keys are ascending."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Encoder:
    """Byte-level BPE by the tokenizers library; the ids of pre-tokens, which recur, are kept.

    A text's ids are those of its pre-tokens, one after the other, as merges never cross them. Pre-tokens are found and
    recognised (by 64 bits of hash) many texts at a time; the library encodes those not met before. Texts with unusual
    characters or a special token's string go to the library whole, and so do all texts where the tokenizer is no byte-level BPE
    with the usual pattern and no normaliser.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], self.kind).tobytes()
        before, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        #: whether piece_starts splits as this tokenizer does; texts go to any other one whole
        self.splits = (
            self.tokenizer.normalizer is None
            and isinstance(before, pre_tokenizers.ByteLevel)
            and (before.add_prefix_space, before.use_regex) == (False, True)
            and isinstance(model, models.BPE)
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        )
        self.known, self.recent = Known(self.kind), Known(self.kind)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = self._raw(pieces)
        if len(self.recent.keys) + len(keys) > RECENT_PIECES:
            r = self.recent
            order = np.argsort(r.at)  # the pool's own order
            self.known.add(r.keys[order], r.n[order], r.pool)
            self.recent = Known(self.kind)
        self.recent.add(keys, np.array([len(x) for x in found], np.int64), np.concatenate(found))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, with the end, as bytes."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, offsets = T.strings(column)
        if not len(column):
            return []
        starts, odd = piece_starts(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(len(column), bool))
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(mark, at + 1)
        if not self.splits:
            odd[:] = True
        ends = np.append(starts[1:], len(data))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if odd.any():
            keep = ~odd[owner]
            starts, ends, owner = starts[keep], ends[keep], owner[keep]
        out: list[bytes] = [self.end] * len(column)
        if len(starts):
            hashes = self._hashes(data, starts, ends)
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known.keys) > CACHE_PIECES:
                self.known, self.recent = Known(self.kind), Known(self.kind)
            place, late = self.known.find(keys), self.recent.find(keys)
            missing = np.flatnonzero((place < 0) & (late < 0))
            if len(missing):
                self._learn(keys[missing], [raw[s:e].decode() for s, e in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
                place, late = self.known.find(keys), self.recent.find(keys)
            old = place >= 0
            at = np.where(old, self.known.at[place] if len(self.known.at) else 0, (self.recent.at[late] if len(self.recent.at) else 0) + len(self.known.pool))
            n = np.where(old, self.known.n[place] if len(self.known.n) else 0, self.recent.n[late] if len(self.recent.n) else 0)
            pool = np.concatenate([self.known.pool, self.recent.pool])
            sizes = n[inverse]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pool[np.repeat(at[inverse] - bounds[:-1], sizes) + np.arange(bounds[-1])]
            cuts = bounds[np.searchsorted(owner, np.arange(len(column) + 1))]
            flat, cuts = ids.tobytes(), (cuts * self.width).tolist()
            out = [flat[a:b] + self.end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self._raw([raw[offsets[i] : offsets[i + 1]].decode() for i in whole]), strict=True):
            out[i] = ids.tobytes() + self.end
        return out

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that went to the library leave gaps; what lies between two gaps follows each other."""
        gaps = np.flatnonzero(starts[1:] != ends[:-1]) + 1
        return np.concatenate([hash_pieces(data, s, e) for s, e in zip(np.split(starts, gaps), np.split(ends, gaps), strict=True)])


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker: what it has learned stays."""
    return Encoder(path)


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


INDEX = "shard string, ordinal bigint, offset bigint, length bigint, doc_id bigint, before bigint, n_tokens bigint, shard_no int"


def write(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write docs' records under folder and return the index, which is a table at folder/index."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        number = TaskContext.get().partitionId()
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        shard = f"tokens-{number:06d}-{uuid.uuid4().hex}.rec"
        head = bytes([encoder.width])
        offset = ordinal = before = 0
        with system.open_output_stream(f"{root}/{shard}") as out:
            for b in batches:
                ids, values = b["doc_id"].to_pylist(), b["text"]
                sizes = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(ids):
                    stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                    found = []
                    for doc_id, payload in zip(ids[at:stop], encoder.encode(values.slice(at, stop - at)), strict=True):
                        record = frame(head + payload)
                        out.write(record)
                        n = len(payload) // encoder.width
                        found.append((shard, ordinal, offset, len(record), doc_id, before, n, number))
                        offset, ordinal, before = offset + len(record), ordinal + 1, before + n
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), KINDS, strict=True)], NAMES)
                    at = stop

    ordered.select("doc_id", "text").mapInArrow(rows, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]
KINDS = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[x.split(" ")[1]] for x in INDEX.split(", ")]


def read(index: DataFrame, folder: str) -> DataFrame:
    """(index's columns, ids): the records that rows of an index point at, in any order, each checked."""
    names = index.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "ids array<bigint>"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in fetched(batches, folder):
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            values = np.concatenate(found) if found else np.zeros(0, "<u4")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int64)))], [*names, "ids"])

    return index.mapInArrow(rows, schema)


def fetched(batches: Iterator[pa.RecordBatch], folder: str, at_once: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    system, root = filesystem(folder)
    name, file = None, None
    for whole in batches:
        for at in range(0, len(whole), at_once):
            b, found = whole.slice(at, at_once), []
            for shard, offset, length in zip(*(b[c].to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, system.open_input_file(f"{root}/{shard}")
                file.seek(offset)
                found.append(ids_of(unframe(file.read(length))))
            yield b, found
    if file is not None:
        file.close()


def digest(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files."""
    shards = settle(index.groupBy("shard", "shard_no").agg(F.sum("n_tokens").alias("n"), F.sum("length").alias("bytes")), "records-shards")
    count = max(1, shards.count())
    ahead = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = settle(shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "records-bases")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in fetched(batches, folder):
            sizes = pa.array([len(x) for x in found], pa.int64())
            crcs = pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b["shard"], b["doc_id"], b["before"], sizes, crcs], ["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    dealt = index.repartition(count, "shard").sortWithinPartitions("shard", "ordinal")
    found = dealt.mapInArrow(rows, "shard string, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return shuffled_join(found, bases, ["shard"], "inner").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs' records, read them back, and return the digest."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or fresh_dir(docs.sparkSession, "records")
    return digest(write(docs, folder, tokenizer), folder)


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
