"""Token counts without token ids: each distinct pre-token is counted once, and texts sum over their pre-tokens.

Merges never cross pre-tokens, so a text has as many tokens as its pre-tokens together:

1. lexicon: the distinct pre-tokens of all texts with their frequency (map-side partial sums), each counted once by the tokenizer's
   own library;
2. the lexicon's most frequent entries, at most FREQUENT of them, go to all tasks as one table (its size is bounded, whatever the corpus);
   they are looked up where a text lies and compared as bytes;
3. the other pre-tokens, which are rare by their choice and so never crowd a join, leave their text as (row, pre-token, times), meet the
   lexicon in a shuffled join on their bytes, and are summed by row.

Pre-tokens of byte-level BPE are cut for many texts at a time. Texts with characters whose classes are not known here, or with
a special token's string, and other tokenizers of that library, are cut by the library's own steps: special strings, each a pre-token,
then normaliser and pre-tokenizer. Sentence pieces are cut before white space, if no piece of the vocabulary goes on past it.
Where no safe cut is known the whole text is one pre-token.

Defined cases: null and empty texts have no bytes and no tokens; a null key is a key like any other; repeated rows and rows that share
a key are texts of their own; an empty table gives an empty result; other columns are not read, whatever their names. A text is held
whole, with some 40 bytes for each of its own.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, quoted, settle, shuffled_join
from .records import hash_pieces, piece_starts

FREQUENT = 1 << 20
CUT_BYTES = 1 << 22
MARK = "\u2581"  # stands for a space in sentence pieces


class Cut:
    """Pre-tokens of the texts `index`: pre-token i is data[starts[i]:ends[i]], of text index[owner[i]]."""

    def __init__(self, index: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> None:
        self.index, self.data, self.starts, self.ends, self.owner = index, data, starts, ends, owner
        hashes = hash_pieces(data, starts, ends)
        self.keys, self.first, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)

    def distinct(self, which: np.ndarray | None = None) -> pa.Array:
        at = self.first if which is None else self.first[which]
        raw = self.data.tobytes()
        return pa.array([raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)], pa.binary())


class Library:
    """A tokenizer of the tokenizers library, from its .json file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer, self.before, model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content for t in added]
        #: whether the library's steps can be taken one by one
        self.stepwise = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added) and self.before is not None
        #: whether a pre-token is its stretch of the text, and found by piece_starts
        self.usual = (
            self.stepwise
            and self.normalizer is None
            and isinstance(self.before, pre_tokenizers.ByteLevel)
            and (self.before.add_prefix_space, self.before.use_regex) == (False, True)
            and isinstance(model, models.BPE)
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        )
        self.mark = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold a special token's string."""
        out, raw = np.zeros(len(offsets) - 1, dtype=bool), data.tobytes()
        for mark in map(str.encode, self.special):
            at = raw.find(mark)
            while at >= 0:
                out[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(mark, at + 1)
        return out

    def fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.usual:
            return np.zeros(0, np.int64), np.ones(len(offsets) - 1, dtype=bool)
        starts, strange = piece_starts(data, offsets)
        return starts, strange | self.odd(data, offsets)

    def slow(self, text: str) -> list[str]:
        if not self.stepwise:
            return [text]
        out, at = [], 0
        for found in [*(self.mark.finditer(text) if self.mark else ()), None]:
            if between := text[at : found.start() if found else len(text)]:
                out += self.pieces(between)
            if found:
                out.append(found[0])
                at = found.end()
        return out

    def pieces(self, text: str) -> list[str]:
        if not self.usual:
            return [piece for piece, _ in self.before.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)]
        cuts = [text[a:b] for _, (a, b) in self.before.pre_tokenize_str(text)]
        return cuts if "".join(cuts) == text else [text]

    def count(self, pieces: list[str]) -> list[int]:
        if self.usual or not self.stepwise:
            return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        special, model = set(self.special), self.tokenizer.model
        return [1 if x in special else len(model.tokenize(x)) for x in pieces]


class Sentences:
    """A sentencepiece model, from its .model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.safe = self._safe() and not any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(k)) for k in range(len(self.model)))

    def _safe(self) -> bool:
        """Whether the model takes texts as they are, behind one space."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        own = sentencepiece_model_pb2.ModelProto()
        own.ParseFromString(self.model.serialized_model_proto())
        rule = own.normalizer_spec
        return rule.name == "identity" and not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces

    def fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.ones(len(offsets) - 1, dtype=bool)

    def slow(self, text: str) -> list[str]:
        """Cut before white space; the model puts a space before the text."""
        if not self.safe:
            return [text]
        return re.findall(f"[ {MARK}]+[^ {MARK}]*", f" {text}") if text else []

    def count(self, pieces: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(pieces, num_threads=1)]
        # each pre-token starts with a space, which the model adds itself; a space alone it would not
        return [1 if p in (" ", MARK) else len(x) for p, x in zip(pieces, self.model.encode([p[1:] for p in pieces], num_threads=1), strict=True)]


@functools.lru_cache(maxsize=4)
def tokenizer_for(path: str) -> Library | Sentences:
    """One tokenizer for all tasks of a Python worker."""
    return Sentences(path) if path.endswith(".model") else Library(path)


def cuts(column: pa.Array, path: str) -> Iterator[Cut]:
    """The pre-tokens of a column of texts, CUT_BYTES of text at a time; a longer text is a part of its own."""
    tokenizer = tokenizer_for(path)
    data, offsets = T.strings(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CUT_BYTES, side="right")) - 1)
        own, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(own):
            index = np.arange(first, last)
            starts, odd = tokenizer.fast(own, bounds)
            if odd.any():
                raw, chosen = own.tobytes(), np.flatnonzero(odd)
                found = [[p.encode() for p in tokenizer.slow(raw[bounds[d] : bounds[d + 1]].decode())] for d in chosen.tolist()]
                sizes = np.array([len(p) for f in found for p in f], dtype=np.int64)
                ends = np.cumsum(sizes)
                if len(ends):
                    yield Cut(index[chosen], np.frombuffer(b"".join(p for f in found for p in f), np.uint8), ends - sizes, ends, np.repeat(np.arange(len(found)), [len(f) for f in found]))
                rest = np.repeat(~odd, np.diff(bounds))  # the bytes of the others close ranks
                ahead = np.concatenate([[0], np.cumsum(rest)])
                starts = ahead[starts[rest[starts]]]
                own, bounds, index = own[rest], ahead[bounds][np.append(~odd, True)], index[~odd]
            if len(starts):
                yield Cut(index, own, starts, np.append(starts[1:], len(own)), np.searchsorted(bounds, starts, side="right") - 1)
        first = last


def lexicon(texts: DataFrame, path: str) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token of column text, how often it occurs, and its number of tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in cuts(b["text"], path):
                yield pa.RecordBatch.from_arrays([cut.distinct(), pa.array(np.bincount(cut.inverse))], ["piece", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["piece"], b["n"], pa.array(tokenizer.count([p.decode() for p in b["piece"].to_pylist()]), pa.int64())], ["piece", "n", "tokens"])

    sums = texts.select("text").mapInArrow(pieces, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return sums.mapInArrow(counted, "piece binary, n bigint, tokens bigint")


def eighths(n: Column) -> Column:
    """Frequencies in steps of an eighth of a power of two: at most 512 of them."""
    return F.floor(F.log2(n) * 8).cast("int")


class Frequent:
    """The frequent pre-tokens, by hash, with their bytes and numbers of tokens."""

    def __init__(self, pieces: pa.Array, tokens: np.ndarray) -> None:
        data, offsets = binaries(pieces)
        keys = hash_pieces(data, offsets[:-1], offsets[1:]) if len(pieces) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.data, self.starts, self.ends, self.tokens = keys[order], data, offsets[:-1][order], offsets[1:][order], tokens[order]

    def find(self, cut: Cut) -> np.ndarray:
        """The tokens of each distinct pre-token of cut, -1 for those not here."""
        out = np.full(len(cut.keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, cut.keys), len(self.keys) - 1)
        starts, sizes = cut.starts[cut.first], (cut.ends - cut.starts)[cut.first]
        same = np.flatnonzero((self.keys[at] == cut.keys) & ((self.ends - self.starts)[at] == sizes))
        n = sizes[same]
        bounds = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(bounds, n)
        equal = cut.data[np.repeat(starts[same], n) + step] == self.data[np.repeat(self.starts[at[same]], n) + step]
        sure = same[np.logical_and.reduceat(equal, bounds)] if len(same) else same
        out[sure] = self.tokens[at[sure]]
        return out


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def frequent(words: DataFrame, limit: int) -> tuple[int, Frequent]:
    """The least step of frequency that the table holds, and the table: at most `limit` entries."""
    steps = sorted(((r["step"], r["rows"]) for r in words.groupBy(eighths(F.col("n")).alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for step, rows in steps:
        total += rows
        if total > limit:
            break
        least = step
    table = words.filter(eighths(F.col("n")) >= least).select("piece", "tokens").toArrow()
    return least, Frequent(pa.concat_arrays(table["piece"].chunks) if len(table) else pa.array([], pa.binary()), table["tokens"].to_numpy())


def count(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", limit: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    words = settle(lexicon(texts, tokenizer), "counts-lexicon")
    least, table = frequent(words, limit)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, n_bytes = np.zeros(len(b), np.int64), np.diff(T.strings(b["text"])[1])
            owners, times, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.binary())]
            for cut in cuts(b["text"], tokenizer):
                tokens = shared.value.find(cut)
                np.add.at(known, cut.index, np.bincount(cut.owner, np.maximum(tokens, 0)[cut.inverse], len(cut.index)).astype(np.int64))
                rare = np.flatnonzero(tokens < 0)
                if len(rare):
                    number = np.full(len(tokens), -1)
                    number[rare] = np.arange(len(rare))
                    chosen = np.flatnonzero(tokens[cut.inverse] < 0)
                    pair, n = np.unique(cut.owner[chosen] * len(rare) + number[cut.inverse[chosen]], return_counts=True)
                    owners.append(cut.index[pair // len(rare)])
                    times.append(n)
                    pieces.append(cut.distinct(rare).take(pa.array(pair % len(rare))))
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(b)))])
            flat = pa.StructArray.from_arrays([pa.concat_arrays(pieces).take(pa.array(order)), pa.array(np.concatenate(times)[order])], ["piece", "times"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_bytes), pa.array(known), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], ["doc_id", "n_bytes", "known", "rare"])

    found = texts.mapInArrow(rows, "doc_id bigint, n_bytes bigint, known bigint, rare array<struct<piece:binary,times:bigint>>")
    found = settle(found.withColumn("row", F.monotonically_increasing_id()), "counts-rows")  # settled: row numbers stay
    met = shuffled_join(found.select("row", F.inline("rare")), words.filter(eighths(F.col("n")) < least).select("piece", "tokens"), ["piece"], "inner")
    rare = met.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("others"))
    return shuffled_join(found.drop("rare"), rare, ["row"]).select("doc_id", "n_bytes", (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 1024)
