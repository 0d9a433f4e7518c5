"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's term vector holds hashed byte trigrams (tf-idf) and event terms: for each of a few whole-text ratios
(repeated words, repeats of the preceding word, distinct words, symbols, lone symbols, digits, capitals, repeated lines, word length,
text length) two neighbouring bins of a fixed grid share a weight. A truncated singular value decomposition of a
bounded labelled sample gives the latent axes. The labelled latent vectors are broadcast (sample_rows * rank
floats, known beforehand); each batch of documents is multiplied with them in blocks, so every cosine is exact, and the
k nearest vote with weight max(cosine, 0)**sharpness.

A document of the sample is scored like any other, from its text alone, so its own label is among its votes, as are
those of its copies; held-out documents' labels are in no vote.

Defined cases: null and empty texts have only event terms and are scored like any other; a null doc_id is never
learned from and not held out; a doc_id labelled more than once takes the mean label; repeated rows are scored alike;
nearest neighbours that tie (cosines are rounded to 2**-20) are taken in the order of the sample (by hash of doc_id). With no
labelled row every score is 0.5; an empty table gives an empty result. Columns other than doc_id and text are not read; `score`
replaces those called held_out, score or predicted, `keep` hands on all. A long text is held whole, with some 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textops as T
from .common import crc_rest, documents, least_hashed, quoted

TRIGRAMS = 2048
BINS = 24
EVENTS = 10
TERMS = TRIGRAMS + EVENTS * BINS
ROWS_AT_ONCE = 512
STEPS = np.float32(1 << 20)
SPARE, ITERATIONS = 24, 8  # of the subspace iteration


def trigram_terms(w: T.Words) -> np.ndarray:
    """Counts of hashed, lower-cased byte trigrams: a row for each text."""
    out = np.zeros((w.n, TRIGRAMS), dtype=np.float32)
    if len(w.data) < 3:
        return out
    low = T._LOWER[w.data].astype(np.uint32)
    code = low[:-2] + (low[1:-1] << np.uint32(8)) + (low[2:] << np.uint32(16))
    code = (code * np.uint32(2654435761)) >> np.uint32(21)
    for d in range(w.n):
        out[d] = np.bincount(code[w.offsets[d] : max(w.offsets[d], w.offsets[d + 1] - 2)], minlength=TRIGRAMS)
    return out


def ratios(w: T.Words) -> np.ndarray:
    """The whole-text ratios, each within 0 and 1: a row for each text."""
    data, n_words, n_bytes = w.data, w.counts, np.diff(w.offsets)
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(n_bytes, 1)

    def share(flags: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / of

    owners = w.owners()
    again = np.zeros(len(w.hashes), dtype=bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owners[1:] == owners[:-1])
    order = np.lexsort((w.hashes, owners))
    ordered = w.hashes[order]
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]) | (owners[order][1:] != owners[order][:-1])
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    symbol = ~letter & ~digit & ~T._IS_SPACE[data] & ~np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    lettered = np.concatenate([[0], np.cumsum(letter | digit, dtype=np.int64)])
    lone = lettered[w.ends] == lettered[w.starts]
    runs = np.flatnonzero(fresh)
    most = np.zeros(w.n)
    if len(runs):
        sizes = np.diff(np.append(runs, len(ordered)))
        np.maximum.at(most, owners[order][runs], sizes)
    lines = np.zeros(w.n)
    for d in range(w.n):
        text = data[w.offsets[d] : w.offsets[d + 1]].tobytes().split(b"\n")
        lines[d] = 1 - len(set(text)) / len(text)
    return np.stack(
        [
            share(again, w.bounds, per_word),
            share(fresh, w.bounds, per_word),
            most / per_word,
            share(symbol, w.offsets, per_byte),
            share(lone, w.bounds, per_word),
            share(digit, w.offsets, per_byte),
            share((data >= 65) & (data <= 90), w.offsets, per_byte),
            lines,
            np.minimum(share(~T._IS_SPACE[data], w.offsets, per_word) / 30, 1),
            np.minimum(np.log1p(n_bytes) / 16, 1),
        ],
        axis=1,
    )


def event_terms(values: np.ndarray) -> np.ndarray:
    """Each ratio, on a square-root grid, split between its two nearest bins."""
    at = np.sqrt(np.clip(values, 0, 1)) * (BINS - 1)
    low = np.minimum(at.astype(np.int64), BINS - 2)
    rest = (at - low).astype(np.float32)
    out = np.zeros((len(values), values.shape[1] * BINS), dtype=np.float32)
    rows, base = np.arange(len(values))[:, None], np.arange(values.shape[1]) * BINS
    out[rows, base + low] = 1 - rest
    out[rows, base + low + 1] = rest
    return out


def terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    for w in T.chunks(column):
        out = np.empty((w.n, TERMS), dtype=np.float32)
        out[:, :TRIGRAMS] = np.log1p(trigram_terms(w))
        out[:, TRIGRAMS:] = event_terms(ratios(w))
        yield w.first, out


@dataclass
class Model:
    """idf: weights of terms; axes: terms x rank; vectors: labelled rows x rank, of length 1; labels: 0 to 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float
    event_weight: float

    def weigh(self, x: np.ndarray) -> np.ndarray:
        out = x * self.idf
        grams, events = out[:, :TRIGRAMS], out[:, TRIGRAMS:]
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        events *= self.event_weight / np.maximum(np.linalg.norm(events, axis=1, keepdims=True), 1e-9)
        return out

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = self.weigh(x) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def votes(self, near: np.ndarray) -> np.ndarray:
        """Scores from rows of cosines: the k largest vote; of equal ones the first in order of the sample."""
        k = min(self.neighbours, near.shape[1])
        near = np.rint(near * STEPS) / STEPS  # so that equal labelled rows tie, whatever the order in which a product was summed
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        chosen, level = near > least, near == least
        short = k - chosen.sum(axis=1)
        many = np.flatnonzero(level.sum(axis=1) != short)  # rows where not all that tie can vote
        level[many] &= np.cumsum(level[many], axis=1) <= short[many, None]
        rows, columns = np.nonzero(chosen | level)  # k in each row
        weights = np.maximum(near[rows, columns].astype(np.float64), 1e-6).reshape(len(near), k) ** self.sharpness
        return (weights * self.labels[columns].reshape(len(near), k)).sum(axis=1) / weights.sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        for at in range(0, len(x), ROWS_AT_ONCE):
            out[at : at + ROWS_AT_ONCE] = self.votes(self.latent(x[at : at + ROWS_AT_ONCE]) @ self.vectors.T)
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 25, sharpness: float = 8.0, event_weight: float = 1.5, seed: int = 5) -> Model:
    """Latent axes and labelled vectors from the sample's term rows (half floats), a block of rows at a time.

    The axes are the leading right singular vectors, by subspace iteration: no terms x terms matrix is held.
    """
    blocks = [slice(at, at + ROWS_AT_ONCE) for at in range(0, len(x), ROWS_AT_ONCE)]
    seen = sum(((x[b] > 0).sum(axis=0) for b in blocks), np.zeros(TERMS, dtype=np.int64))
    idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + np.float32(0.5)
    model = Model(idf, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float64), neighbours, sharpness, event_weight)
    if len(x):
        weighed = [model.weigh(x[b].astype(np.float32)) for b in blocks]
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, rank + SPARE)).astype(np.float32))[0]
        for _ in range(ITERATIONS):
            basis = np.linalg.qr(sum(w.T @ (w @ basis) for w in weighed))[0]
        small = sum((y := w @ basis).T @ y for w in weighed)
        model.axes = np.ascontiguousarray(basis @ np.linalg.eigh(small)[1][:, : -rank - 1 : -1])
        model.vectors = np.concatenate([(y := w @ model.axes) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9) for w in weighed])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term rows and labels of at most sample_rows labelled documents whose crc32 remainder is not 2, by hash of key."""
    known = (
        labels.filter(crc_rest("doc_id", 4) != 2)
        .groupBy("doc_id")
        .agg(F.avg(F.col(label)).alias("label"))
        .filter(F.col("label").isNotNull())
    )
    chosen = least_hashed(known, F.xxhash64("doc_id"), sample_rows, "doc_id")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x in terms(b["text"]):
                part = b.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "label", "terms"])

    # a doc_id on several rows counts once: the sample stays within its bound
    found = rows.mapInArrow(vectors, "doc_id bigint, label double, terms binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("terms").alias("terms")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    column = found["terms"].combine_chunks().cast(pa.large_binary())
    x = np.frombuffer(column.buffers()[2], np.float16).reshape(-1, TERMS) if len(column) else np.zeros((0, TERMS), np.float16)
    return x, found["label"].to_numpy(zero_copy_only=False)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4096, threshold: float = 0.7, key: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """docs' columns with held_out, score and predicted (columns of these names are replaced); sample_rows bounds what is learned from and broadcast."""
    docs = docs.select(*(quoted(c) for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, label, sample_rows, key, text), **options))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores_of(b[text], shared.value))], [*b.schema.names, "score"])

    held_out = F.coalesce(crc_rest(key, 4) == 2, F.lit(False))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(scored, schema).withColumns({"held_out": held_out, "predicted": (F.col("score") >= threshold).cast("int")})


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4096, threshold: float = 0.7, key: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns as they are, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, label, sample_rows, key, text), **options))
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores_of(b.column(place), shared.value) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def scores_of(column: pa.Array, model: Model) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.scores(x) for _, x in terms(column))])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
