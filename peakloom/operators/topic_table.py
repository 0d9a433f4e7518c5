"""Topic training where the topic-word table has any size: it is partitioned by word, and blocks of documents fetch the words they have.

The same variational Bayes as in `lda`, whose table every task holds. Here a block of documents, at most BLOCK_CELLS numbers (topics
and CELL of them for each cell; a longer document is a block by itself), fetches its words' rows in a shuffled join, infers its documents, and
hands on sums by word, which add up to the next table. The driver sees the topics' totals and the prior, a number for each topic.

A word that no document has keeps the prior's weight and has no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lda import BOUND, DOCUMENTS, ENTROPY, LOG_THETA, TOKENS, _entropies, digamma, expected_log, local_steps, newton_alpha, settled
from .shared import settle
from .vectors import arrays, matrix, meet, places, summed, vector_sums

BLOCK_CELLS = 1 << 22
CELL = 28  # numbers that a cell takes besides its topics': its document's name, id, count, places and orders, in Arrow and in numpy
SHARES = -6  # in a word's place, as the names from lda: expected counts by topic


@dataclass
class TopicTable:
    rows: DataFrame  # (id, v): a word's weight in each topic
    totals: np.ndarray  # by topic, over all words
    alpha: np.ndarray
    vocabulary: int
    eta: float
    history: list[float] = field(default_factory=list)
    #: for each epoch: log_likelihood and perplexity of a token, mean entropies of documents and topics, relative changes of table and prior
    checks: list[dict[str, float]] = field(default_factory=list)


def blocked(cells: DataFrame, topics: int) -> DataFrame:
    """Cells (doc, id, n) with `block`: documents dealt by hash, so that a block has about BLOCK_CELLS / (topics + CELL) cells."""
    blocks = max(1, -(-cells.count() * (topics + CELL) // BLOCK_CELLS))
    return cells.select("doc", F.col("id").cast("bigint").alias("id"), F.col("n").cast("double").alias("n"), F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"))


def _documents(cells: pa.Table, ids: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, then places of their words among ids, counts, and bounds; words that have no row are left out."""
    at, known = places(cells["id"].to_numpy(), ids)
    coded = cells["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
    owner = coded.indices.to_numpy()
    order = np.lexsort((at, owner))
    order = order[known[order]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[order], minlength=len(coded.dictionary)))])
    return coded.dictionary, at[order], cells["n"].to_numpy()[order], bounds


def _round(cells: DataFrame, model: TopicTable, steps: int, tol: float) -> DataFrame:
    """(id, v): expected counts of words by topic, and the sums that negative ids name."""
    totals, alpha = digamma(model.totals), model.alpha

    def work(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        ids = fetched["id"].to_numpy()
        log_beta = digamma(matrix(fetched["v"])) - totals if len(ids) else np.zeros((0, len(alpha)))
        _, at, counts, bounds = _documents(rows, ids)
        gamma, weighed = local_steps(at, counts, bounds, log_beta, alpha, steps, tol)
        spread = expected_log(gamma)
        p = (np.repeat(np.exp(spread), np.diff(bounds), axis=0) * np.exp(log_beta[at])).sum(axis=1)
        single = {BOUND: (counts * np.log(np.maximum(p, 1e-300))).sum(), DOCUMENTS: len(gamma), TOKENS: counts.sum(), ENTROPY: _entropies(gamma / gamma.sum(axis=1, keepdims=True)).sum()}
        extra = np.zeros((len(single) + 2, len(alpha)))
        extra[: len(single), 0] = list(single.values())
        extra[-2], extra[-1] = spread.sum(axis=0), weighed.sum(axis=0)
        words, sums = summed(pa.array(ids[at]), weighed) if len(at) else (pa.array([], pa.int64()), np.zeros((0, len(alpha))))
        return pa.table({"id": pa.concat_arrays([words, pa.array([*single, LOG_THETA, SHARES], pa.int64())]), "v": arrays(np.concatenate([sums, extra]))})

    return vector_sums(meet(cells, model.rows, "id", work, "id bigint, v array<double>"), "id")


def _moved(new: DataFrame, old: DataFrame, totals: np.ndarray, eta: float) -> np.ndarray:
    """By topic: sum of p log p over the new table's words, and over the words of either table sum of changes and sum of the old weights."""
    topics = len(totals)

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if len(b):
                both = [np.full((len(b), topics), eta) for _ in range(2)]
                for own, name in zip(both, ("v", "w"), strict=True):
                    there = b[name].is_valid().to_numpy(zero_copy_only=False)
                    if there.any():
                        own[there] = matrix(b[name].drop_null())
                p = both[0][b["v"].is_valid().to_numpy(zero_copy_only=False)] / totals
                out = np.concatenate([(p * np.log(p)).sum(axis=0), np.abs(both[0] - both[1]).sum(axis=0), both[1].sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), arrays(out[None])], ["id", "v"])

    joined = new.select("id", "v").join(old.select("id", F.col("v").alias("w")).hint("merge"), "id", "full_outer").select("v", "w")
    found = vector_sums(joined.mapInArrow(work, "id bigint, v array<double>"), "id").collect()
    return np.array(found[0]["v"]).reshape(3, topics) if found else np.zeros((3, topics))


def start(cells: DataFrame, vocabulary: int, topics: int, alpha: float = 0.1, eta: float = 0.01, seed: int = 1) -> TopicTable:
    """Weights around 1 drawn for each word by itself, whichever task has it."""

    def drawn(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b["id"], arrays(np.array([np.random.default_rng([seed, i]).gamma(100.0, 0.01, topics) for i in b["id"].to_pylist()]))], ["id", "v"])

    rows = settle(cells.select(F.col("id").cast("bigint").alias("id")).distinct().mapInArrow(drawn, "id bigint, v array<double>"), "topics-start")
    return given(rows, vocabulary, np.full(topics, alpha), eta)


def given(rows: DataFrame, vocabulary: int, alpha: np.ndarray, eta: float = 0.01) -> TopicTable:
    """A model to go on from: weights (id, v) of words, of which there are `vocabulary`."""
    found = vector_sums(rows.select(F.lit(0).cast("bigint").alias("id"), F.concat("v", F.array(F.lit(1.0))).alias("v")), "id").collect()
    sums = np.array(found[0]["v"]) if found else np.zeros(len(alpha) + 1)
    return TopicTable(rows, sums[:-1] + eta * (vocabulary - sums[-1]), alpha, vocabulary, eta)


def fit(cells: DataFrame, model: TopicTable, epochs: int = 10, steps: int = 30, tol: float = 1e-4, patience: int = 2, learn_alpha: bool = False, criterion: str = "table") -> TopicTable:
    """Rounds over all cells (doc, id, n) from a model on, whose epochs count.

    Stops when the relative change of the table and of the prior is below tol `patience` times in a row, or, with another criterion, when that
    series of `checks` changes by less.
    """
    topics = len(model.alpha)
    cells = settle(blocked(cells, topics), "topics-cells")
    quiet = 0
    for _ in range(epochs - len(model.history)):
        found = settle(_round(cells, model, steps, 1e-3), "topics-round")
        sums = {r["id"]: np.array(r["v"]) for r in found.filter("id < 0").collect()}
        one = lambda name: float(sums[name][0]) if name in sums else 0.0  # noqa: B023, E731
        documents, tokens = max(one(DOCUMENTS), 1.0), max(one(TOKENS), 1.0)
        rows = found.filter("id >= 0").select("id", F.transform("v", lambda x: x + F.lit(model.eta)).alias("v"))
        totals = model.eta * model.vocabulary + sums.get(SHARES, np.zeros(topics))
        alpha = newton_alpha(model.alpha, sums[LOG_THETA] / documents) if learn_alpha and LOG_THETA in sums else model.alpha
        entropy, change, before = _moved(rows, model.rows, totals, model.eta)
        unseen = model.vocabulary - rows.count()
        rest = model.eta / totals
        per_token = one(BOUND) / tokens
        check = {
            "log_likelihood": per_token,
            "perplexity": math.exp(min(-per_token, 700.0)),
            "entropy_doc": one(ENTROPY) / documents,
            "entropy_topic": float((-entropy - unseen * rest * np.log(rest)).mean()),
            "table": float(change.sum() / max(before.sum(), 1e-12)),
            "prior": float(np.abs(alpha - model.alpha).sum() / model.alpha.sum()),
        }
        model = TopicTable(rows, totals, alpha, model.vocabulary, model.eta, [*model.history, one(BOUND)], [*model.checks, check])
        quiet = quiet + 1 if max(check["table"], check["prior"]) < tol else 0
        if quiet >= patience if criterion == "table" else settled([c[criterion] for c in model.checks], tol, patience):
            break
    return model


def infer(cells: DataFrame, model: TopicTable, steps: int = 30, tol: float = 1e-4) -> DataFrame:
    """(doc, topic, p) of documents under frozen topics; words that the model has no row of take no part."""
    totals, alpha = digamma(model.totals), model.alpha

    def work(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        ids = fetched["id"].to_numpy()
        log_beta = digamma(matrix(fetched["v"])) - totals if len(ids) else np.zeros((0, len(alpha)))
        docs, at, counts, bounds = _documents(rows, ids)
        gamma, _ = local_steps(at, counts, bounds, log_beta, alpha, steps, tol)
        return pa.table({"doc": docs, "theta": arrays(gamma / gamma.sum(axis=1, keepdims=True))})

    kind = f"doc {cells.schema['doc'].dataType.simpleString()}, theta array<double>"
    return meet(blocked(cells, len(alpha)), model.rows, "id", work, kind).select("doc", F.posexplode("theta").alias("topic", "p"))


def table(model: TopicTable, words: DataFrame) -> DataFrame:
    """(topic, word, p): the topic-word table, from the vocabulary (word, id)."""
    totals, topics = F.array(*map(F.lit, map(float, model.totals))), len(model.totals)
    rest = F.array(*[F.lit(float(model.eta))] * topics)
    joined = words.join(model.rows.hint("merge"), "id", "left")
    shares = F.zip_with(F.coalesce("v", rest), totals, lambda x, t: x / t)
    return joined.select("word", F.posexplode(shares).alias("topic", "p")).select("topic", "word", "p")
