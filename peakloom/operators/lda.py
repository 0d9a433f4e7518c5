"""Latent Dirichlet allocation by variational Bayes, and inference with frozen topics.

Documents stay distributed as (doc, words array, counts array), and a batch of them is inferred at once. The topic-word table, topics
times vocabulary, is held by the driver and broadcast; its size is checked against TABLE_CELLS, and `topic_table` trains larger ones. Expected
counts come back as sums of whole vectors by word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import arrays, matrix, vector_sums

#: Values in the place of a word's number: the bound, the number of documents, expected log shares by topic, tokens, summed entropies of documents.
BOUND, DOCUMENTS, LOG_THETA, TOKENS, ENTROPY = -1, -2, -3, -4, -5
TABLE_CELLS = 100_000_000
AT_ONCE = 2000  # documents whose steps are taken together: their arrays stay in the processor's cache


def digamma(x: np.ndarray) -> np.ndarray:
    """Six steps of the recurrence, the first with the last and so on in one quotient, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    z = x * (x + 5)
    steps = (2 * x + 5) * (1 / z + 1 / (z + 4) + 1 / (z + 6))
    y = x + 6
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - steps


def expected_log(a: np.ndarray) -> np.ndarray:
    return digamma(a) - digamma(np.einsum("...i->...", a))[..., None]


def trigamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 6 and the asymptotic series."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out = np.where(small, out + 1 / np.where(small, x, 1) ** 2, out)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def newton_alpha(alpha: np.ndarray, mean_log: np.ndarray, steps: int = 20, least: float = 1e-9) -> np.ndarray:
    """The Dirichlet parameters that maximise the likelihood of mean expected log shares, by Newton steps.

    The Hessian is a diagonal plus a constant, so a step costs as much as the gradient. A step is halved until the
    likelihood does not fall and all parameters stay above `least`.
    """

    def value(a: np.ndarray) -> float:
        return math.lgamma(a.sum()) - float(log_gamma(a).sum()) + float(((a - 1) * mean_log).sum())

    alpha = np.maximum(alpha, least)
    for _ in range(steps):
        gradient = digamma(alpha.sum()) - digamma(alpha) + mean_log
        diagonal = -trigamma(alpha)
        shared = float(trigamma(alpha.sum()))
        offset = (gradient / diagonal).sum() / (1 / shared + (1 / diagonal).sum())
        step = (gradient - offset) / diagonal
        now, size = value(alpha), 1.0
        while size > 1e-6:
            new = alpha - size * step
            if (new > least).all() and value(new) >= now:
                break
            size /= 2
        else:
            return alpha
        moved = np.abs(new - alpha).sum() / alpha.sum()
        alpha = new
        if moved < 1e-6:
            break
    return alpha


def local_steps(ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray, log_beta: np.ndarray, alpha: np.ndarray, steps: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(gamma (documents x topics), expected topic counts (cells x topics)) of documents with cells bounds[d]..bounds[d + 1].

    log_beta: words x topics. Each document starts from an even spread of its tokens, and rests when its gamma moves by less than tol.
    """
    gamma, weighed = np.empty((len(bounds) - 1, len(alpha))), np.zeros((len(ids), len(alpha)))
    for first in range(0, len(gamma), AT_ONCE):
        own = bounds[first : first + AT_ONCE + 1]
        cells = slice(own[0], own[-1])
        gamma[first : first + AT_ONCE] = _steps(log_beta[ids[cells]], counts[cells], own - own[0], alpha, steps, tol, weighed[cells])
    return gamma, weighed


def _row_sums(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", x)  # no threads of its own, as a product with ones would have


def _steps(beta: np.ndarray, counts: np.ndarray, bounds: np.ndarray, alpha: np.ndarray, steps: int, tol: float, weighed: np.ndarray) -> np.ndarray:
    """gamma of documents, and their cells' expected counts put into `weighed`; beta: cells x topics.

    Weights are exp(topic of the document) * exp(topic of the word), each scaled by its largest; where all products are tiny they are made in logs.
    """
    sizes = np.diff(bounds)
    gamma = alpha + (np.add.reduceat(np.append(counts, 0.0), bounds[:-1]) * (sizes > 0))[:, None] / len(alpha)
    active = np.flatnonzero(sizes > 0)
    cells, weight, space = np.arange(len(beta)), np.exp(beta - beta.max(axis=1, keepdims=True)), np.empty_like(beta)
    for step in range(steps):
        if not len(active):
            break
        n, now = sizes[active], gamma[active]
        owner = np.repeat(np.arange(len(active)), n)
        spread = expected_log(now)
        phi = np.take(np.exp(spread - spread.max(axis=1, keepdims=True)), owner, axis=0, out=space[: len(owner)], mode="clip")
        phi *= weight
        norm = _row_sums(phi)
        tiny = np.flatnonzero(norm < 1e-200)
        if len(tiny):
            score = spread[owner[tiny]] + beta[cells[tiny]]
            phi[tiny] = np.exp(score - score.max(axis=1, keepdims=True))
            norm[tiny] = _row_sums(phi[tiny])
        phi *= (counts[cells] / norm)[:, None]
        new = alpha + np.add.reduceat(phi, np.cumsum(n) - n, axis=0)
        gamma[active] = new
        going = _row_sums(np.abs(new - now)) >= tol * _row_sums(np.abs(now)) if step + 1 < steps else np.zeros(len(active), dtype=bool)
        if not going.all():
            on = going[owner]
            weighed[cells[~on]] = phi[~on]
            active, cells, weight = active[going], cells[on], weight[on]
    return gamma


def document_bounds(ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray, log_beta: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """The evidence lower bound of each document, with the best topics of its words summed out."""
    log_theta = expected_log(gamma)
    score = np.repeat(log_theta, np.diff(bounds), axis=0) + log_beta[ids]
    top = score.max(axis=1, initial=-np.inf)
    token = counts * (top + np.log(np.exp(score - top[:, None]).sum(axis=1)))
    tokens = np.add.reduceat(np.append(token, 0.0), bounds[:-1]) * (np.diff(bounds) > 0)
    prior = math.lgamma(alpha.sum()) - log_gamma(alpha).sum() - log_gamma(gamma.sum(axis=1)) + log_gamma(gamma).sum(axis=1)
    return prior + ((alpha - gamma) * log_theta).sum(axis=1) + tokens


@dataclass
class TopicModel:
    lam: np.ndarray  # topics x words
    alpha: np.ndarray
    words: list[str]
    history: list[float] = field(default_factory=list)
    #: for each epoch: log_likelihood and perplexity of a token, mean entropies of documents and topics
    checks: list[dict[str, float]] = field(default_factory=list)

    @property
    def beta(self) -> np.ndarray:
        return self.lam / self.lam.sum(axis=1, keepdims=True)


def bags(corpus: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, ids, counts) from (doc, word, n) and (word, id)."""
    cells = corpus.join(words, "word").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("c"))
    return cells.select("doc", F.transform("c", lambda x: x["id"]).alias("ids"), F.transform("c", lambda x: x["n"]).alias("counts"))


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(b["ids"].value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    return b["ids"].flatten().to_numpy(), b["counts"].flatten().to_numpy().astype(float), bounds


def _entropies(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.where(p == 0, 1e-12, p))).sum(axis=1)


def _inferred(docs: DataFrame, model: TopicModel, steps: int, tol: float, values: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(expected_log(model.lam).T), model.alpha))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_beta, alpha = shared.value
        for b in batches:
            if len(b):
                ids, counts, bounds = _cells(b)
                gamma, _ = local_steps(ids, counts, bounds, log_beta, alpha, steps, tol)
                yield pa.RecordBatch.from_arrays([b["doc"], values(ids, counts, bounds, log_beta, gamma)], ["doc", name])

    return docs.select("doc", "ids", "counts").mapInArrow(rows, f"doc {docs.schema['doc'].dataType.simpleString()}, {name} {kind}")


def _step(docs: DataFrame, model: TopicModel, steps: int, tol: float) -> dict[int, np.ndarray]:
    """By word: expected counts by topic; and the sums that BOUND and the others name, single ones in the first place."""
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(expected_log(model.lam).T), model.alpha))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_beta, alpha = shared.value
        topics = len(alpha)
        total, seen, sums, log_theta = np.zeros_like(log_beta), np.zeros(len(log_beta), dtype=bool), dict.fromkeys((BOUND, DOCUMENTS, TOKENS, ENTROPY), 0.0), np.zeros(topics)
        for b in batches:
            if not len(b):
                continue
            ids, counts, bounds = _cells(b)
            gamma, weighed = local_steps(ids, counts, bounds, log_beta, alpha, steps, tol)
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            if len(first):
                total[ids[order][first]] += np.add.reduceat(weighed[order], first, axis=0)
                seen[ids[order][first]] = True
            spread = expected_log(gamma)
            log_theta += spread.sum(axis=0)
            p = (np.repeat(np.exp(spread), np.diff(bounds), axis=0) * np.exp(log_beta[ids])).sum(axis=1)
            for key, value in ((BOUND, (counts * np.log(np.maximum(p, 1e-300))).sum()), (DOCUMENTS, len(b)), (TOKENS, counts.sum()), (ENTROPY, _entropies(gamma / gamma.sum(axis=1, keepdims=True)).sum())):
                sums[key] += float(value)
        single = np.zeros((len(sums), topics))
        single[:, 0] = list(sums.values())
        word = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word, list(sums), [LOG_THETA]]).astype(np.int64)), arrays(np.concatenate([total[word], single, log_theta[None]]))], ["id", "v"])

    found = vector_sums(docs.select("ids", "counts").mapInArrow(rows, "id bigint, v array<double>"), "id").toArrow()
    return dict(zip(found["id"].to_pylist(), matrix(found["v"]), strict=True))


def settled(values: list[float], threshold: float, window: int) -> bool:
    """Whether the last `window` relative changes are all below the threshold, once there are more values than that."""
    changes = [abs(b - a) / max(abs(a), 1e-12) for a, b in zip(values, values[1:], strict=False)]
    return len(values) > window and all(c < threshold for c in changes[-window:])


def fit(docs: DataFrame, words: list[str], topics: int, epochs: int = 10, steps: int = 30, alpha: float = 0.1, eta: float = 0.01, tol: float = 1e-4, patience: int = 2, seed: int = 1, start: TopicModel | None = None, after: Callable[[TopicModel], None] | None = None, learn_alpha: bool = False, criterion: str = "bound", limit: int = TABLE_CELLS) -> TopicModel:
    """Batch variational Bayes over bags; stops when the criterion changes by less than tol from epoch to epoch, `patience` times in a row.

    criterion: "bound", or one of the series in `checks`. start: a model to go on from, whose epochs count; after: called with the
    model at the end of each epoch. A table of more than `limit` cells is an error: `topic_table` takes those.
    """
    if topics * len(words) > limit:
        raise ValueError(f"{topics} topics of {len(words)} words are more than {limit} cells")
    rng = np.random.default_rng(seed)
    model = start or TopicModel(rng.gamma(100.0, 0.01, (topics, len(words))), np.full(topics, alpha), words)
    if model.words != words or len(model.alpha) != topics:
        raise ValueError("the model to go on from has other words or topics")
    for _ in range(epochs - len(model.history)):
        found = _step(docs, model, steps, 1e-3)
        lam = np.full_like(model.lam, eta)
        word = np.array([w for w in found if w >= 0], dtype=np.int64)
        if len(word):
            lam[:, word] += np.array([found[w] for w in word.tolist()]).T
        sums = {w: float(v[0]) for w, v in found.items() if w < 0}
        documents, tokens = max(sums.get(DOCUMENTS, 0.0), 1.0), max(sums.get(TOKENS, 0.0), 1.0)
        if learn_alpha and sums.get(DOCUMENTS):
            model.alpha = newton_alpha(model.alpha, found[LOG_THETA] / documents)
        model.lam = lam
        model.history.append(sums.get(BOUND, 0.0))
        per_token = model.history[-1] / tokens
        model.checks.append({"log_likelihood": per_token, "perplexity": math.exp(min(-per_token, 700.0)), "entropy_doc": sums.get(ENTROPY, 0.0) / documents, "entropy_topic": float(_entropies(model.beta).mean())})
        if after is not None:
            after(model)
        if settled(model.history if criterion == "bound" else [c[criterion] for c in model.checks], tol, patience):
            break
    return model


def infer(docs: DataFrame, model: TopicModel, steps: int = 30, tol: float = 1e-4) -> DataFrame:
    """(doc, topic, p) of bags under frozen topics."""
    shares = lambda ids, counts, bounds, log_beta, gamma: pa.ListArray.from_arrays(pa.array(np.arange(len(gamma) + 1) * gamma.shape[1], pa.int32()), pa.array((gamma / gamma.sum(axis=1, keepdims=True)).reshape(-1)))
    return _inferred(docs, model, steps, tol, shares, "theta", "array<double>").select("doc", F.posexplode("theta").alias("topic", "p"))


def gammas(docs: DataFrame, model: TopicModel, steps: int = 30, tol: float = 1e-4) -> DataFrame:
    """(doc, topic, gamma): the Dirichlet parameters of each bag's mixture under frozen topics."""
    listed = lambda ids, counts, bounds, log_beta, gamma: arrays(gamma)
    return _inferred(docs, model, steps, tol, listed, "g", "array<double>").select("doc", F.posexplode("g").alias("topic", "gamma"))


def responsibilities(docs: DataFrame, model: TopicModel, steps: int = 30, tol: float = 1e-4, least: float = 1e-2) -> DataFrame:
    """(doc, id, topic, p): the shares of topics in each document's words under frozen topics, from `least` on."""
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(expected_log(model.lam).T), model.alpha))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_beta, alpha = shared.value
        for b in batches:
            if len(b):
                ids, counts, bounds = _cells(b)
                _, weighed = local_steps(ids, counts, bounds, log_beta, alpha, steps, tol)
                p = weighed / counts[:, None]
                cell, topic = np.nonzero(p >= least)
                owner = np.searchsorted(bounds, cell, side="right") - 1
                yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(owner)), pa.array(ids[cell].astype(np.int32)), pa.array(topic.astype(np.int32)), pa.array(p[cell, topic])], ["doc", "id", "topic", "p"])

    return docs.select("doc", "ids", "counts").mapInArrow(rows, f"doc {docs.schema['doc'].dataType.simpleString()}, id int, topic int, p double")


def evidence(docs: DataFrame, model: TopicModel, steps: int = 30, tol: float = 1e-4) -> DataFrame:
    """(doc, bound): each bag's evidence lower bound under frozen topics."""
    alpha = model.alpha
    return _inferred(docs, model, steps, tol, lambda ids, counts, bounds, log_beta, gamma: pa.array(document_bounds(ids, counts, bounds, log_beta, alpha, gamma)), "bound", "double")


def table(spark: SparkSession, model: TopicModel) -> DataFrame:
    """(topic, word, p): the topic-word table of a model."""
    topics, words = model.beta.shape
    return spark.createDataFrame(pa.table({"topic": np.repeat(np.arange(topics, dtype=np.int32), words), "word": pa.array(model.words).take(pa.array(np.tile(np.arange(words), topics))), "p": model.beta.reshape(-1)}))


def sweep(docs: DataFrame, words: list[str], counts: list[int], score: Callable[[TopicModel], float], **options: object) -> list[dict[str, float]]:
    """For each number of topics: the score of a model, its last log-likelihood and perplexity."""
    out = []
    for topics in counts:
        model = fit(docs, words, topics, **options)
        out.append({"topics": topics, "score": score(model), **{k: model.checks[-1][k] for k in ("log_likelihood", "perplexity")}})
    return out


def synthetic_corpus(spark: SparkSession, documents: int, tokens: int = 40, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((doc, word, n), topics x words): documents of three topics of six words each among 18, mostly of one topic, for trials of inference."""
    beta = np.full((3, 18), 0.2 / 12)
    for k in range(3):
        beta[k, 6 * k : 6 * k + 6] = 0.8 / 6
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(documents):
        n = rng.multinomial(tokens, rng.dirichlet(np.full(3, 0.3)) @ beta)
        rows += [(d, f"w{w:02d}", int(c)) for w, c in enumerate(n) if c]
    return spark.createDataFrame(rows, "doc bigint, word string, n bigint"), beta
