import math

import numpy as np
import pytest

from peakloom.operators import lda, metrics, network, peaks, similarity, topics


def test_digamma():
    assert lda.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-9)


def slow_step(counts, log_beta, alpha, gamma, steps, tol):
    """One document's coordinate ascent, as its formulas say; log_beta: topics x words."""
    weighed = np.zeros_like(log_beta)
    for _ in range(steps):
        score = lda.expected_log(gamma)[:, None] + log_beta
        phi = np.exp(score - score.max(axis=0))
        weighed = phi / phi.sum(axis=0) * counts
        new = alpha + weighed.sum(axis=1)
        moved = np.abs(new - gamma).sum() / np.abs(gamma).sum()
        gamma = new
        if moved < tol:
            break
    return gamma, weighed


def test_batches_of_documents_by_brute_force():
    rng = np.random.default_rng(2)
    log_beta, alpha = lda.expected_log(rng.gamma(2.0, 1.0, (4, 30))), rng.uniform(0.1, 1, 4)
    sizes = [3, 0, 1, 12, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids, counts = rng.integers(0, 30, bounds[-1]), rng.integers(1, 9, bounds[-1]).astype(float)
    gamma, weighed = lda.local_steps(ids, counts, bounds, np.ascontiguousarray(log_beta.T), alpha, 40, 1e-4)
    bound = lda.document_bounds(ids, counts, bounds, np.ascontiguousarray(log_beta.T), alpha, gamma)
    for d, n in enumerate(sizes):
        at = slice(bounds[d], bounds[d + 1])
        g, w = slow_step(counts[at], log_beta[:, ids[at]], alpha, alpha + counts[at].sum() / 4, 40 if n else 0, 1e-4)
        assert gamma[d] == pytest.approx(g) and weighed[at].T == pytest.approx(w)
        assert weighed[at].sum(axis=1) == pytest.approx(counts[at])
        spread = lda.expected_log(g)
        tokens = sum(c * math.log(sum(math.exp(spread[k] + log_beta[k, i]) for k in range(4))) for c, i in zip(counts[at], ids[at], strict=True))
        prior = math.lgamma(alpha.sum()) - sum(map(math.lgamma, alpha)) - math.lgamma(g.sum()) + sum(map(math.lgamma, g)) + float(((alpha - g) * spread).sum())
        assert bound[d] == pytest.approx(prior + tokens)


def test_topics_of_a_synthetic_corpus(spark):
    corpus, truth = lda.synthetic_corpus(spark, 120)
    words = [f"w{k:02d}" for k in range(18)]
    ids = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, id int")
    docs = lda.bags(corpus, ids).cache()
    model = lda.fit(docs, words, 3, epochs=25, criterion="perplexity", tol=1e-3, seed=3)
    assert len(model.checks) == len(model.history) and model.checks[-1]["perplexity"] < min(18, model.checks[0]["perplexity"])
    assert all(c["perplexity"] == pytest.approx(math.exp(-c["log_likelihood"])) and 0 < c["entropy_doc"] < math.log(3) + 1e-9 for c in model.checks)
    found = metrics.topic_agreement(truth, model.beta, 6)
    assert found["cosine_mean"] > 0.95 and found["jaccard_mean"] > 0.9
    rows = lda.sweep(docs, words, [2, 3], lambda m: metrics.topic_agreement(truth[: len(m.lam)], m.beta, 6)["cosine_mean"], epochs=5)
    assert [r["topics"] for r in rows] == [2, 3]
    assert lda.table(spark, model).groupBy("topic").agg({"p": "sum"}).collect()[0][1] == pytest.approx(1)
    assert lda.evidence(docs, model).filter("bound is null or isnan(bound)").count() == 0
    with pytest.raises(ValueError):
        lda.fit(docs, words, 3, limit=10)


def test_settled():
    assert not lda.settled([1.0, 1.0, 1.0], 0.01, 3) and lda.settled([5.0, 1.0, 1.0, 1.0, 1.001], 0.01, 3) and not lda.settled([1.0, 1.0, 1.0, 2.0], 0.01, 3)


def test_lda_separates_two_topics(spark):
    corpus = spark.createDataFrame([(f"d{i}", w, 5) for i in range(20) for w in (("a", "b") if i % 2 else ("c", "d"))], "doc string, word string, n long")
    ids = spark.createDataFrame([(w, k) for k, w in enumerate("abcd")], "word string, id int")
    docs = lda.bags(corpus, ids).cache()
    model = lda.fit(docs, list("abcd"), 2, epochs=15)
    assert model.history[-1] >= model.history[0]
    best = {r["doc"]: r["topic"] for r in topics.dominant(lda.infer(docs, model)).collect()}
    assert len({best[f"d{i}"] for i in range(0, 20, 2)}) == 1 and best["d0"] != best["d1"]


def test_likelihood(spark):
    theta = spark.createDataFrame([("x", 0, 0.5), ("x", 1, 0.5)], "doc string, topic int, p double")
    beta = spark.createDataFrame([(0, "a", 0.8), (0, "b", 0.2), (1, "a", 0.4), (1, "b", 0.6)], "topic int, word string, p double")
    out = topics.likelihood(spark.createDataFrame([("x", "a", 2), ("x", "zz", 1)], "doc string, word string, n long"), theta, beta).first()
    assert out["nll"] == pytest.approx(-math.log(0.6)) and out["unknown"] == pytest.approx(1 / 3)


def test_shares(spark):
    rows = spark.createDataFrame([("x", 0, 110.0, 200.0)], "doc string, peak_idx int, mz double, precursor double")
    theta = spark.createDataFrame([("x", "m", 0.5), ("x", "n", 0.5)], "doc string, topic string, p double")
    beta = spark.createDataFrame([("m", "frag", 110.0, 0.6), ("n", "loss", 90.0, 0.4)], "topic string, kind string, value double, p double")
    assert {r["topic"]: round(r["share"], 9) for r in topics.shares(rows, theta, beta).collect()} == {"m": 0.6, "n": 0.4}


def test_assignments_and_overlap(spark):
    tokens = spark.createDataFrame([("d", "w", 0), ("d", "w", 0), ("d", "w", 1)], "doc string, word string, topic int")
    phi = topics.assignments(tokens)
    beta = spark.createDataFrame([(0, "w", 0.3), (1, "w", 0.6)], "topic int, word string, p double")
    assert {r["topic"]: round(r["overlap"], 9) for r in topics.overlap(beta, phi).collect()} == {0: 0.2, 1: 0.2}


def test_clean_and_words(spark):
    rows = [("s", m, i, 350.0, None) for m, i in ((100.0, 0.1), (150.0, 0.2), (200.0, 1.0), (2000.0, 9.0))] + [("t", 100.0, 1.0, 350.0, None)]
    df = spark.createDataFrame(rows, "scan string, frag_mz double, frag_intens double, precmz double, loss_mz double")
    assert {(r["scan"], r["frag_mz"]) for r in peaks.clean(df.filter("frag_mz < 2000")).collect()} == {("s", 100.0), ("s", 150.0), ("s", 200.0)}
    words = {r["word"]: r["n"] for r in peaks.words(df.filter("scan = 's' and frag_mz < 2000"), losses=True).collect()}
    assert words == {"frag@100.0": 10, "frag@150.0": 20, "frag@200.0": 100, "loss@250.0": 10, "loss@200.0": 20, "loss@150.0": 100}


def test_masks_hits_and_edges(spark):
    motifs = spark.createDataFrame([("m", [1.0, 2.0])], "motif string, features array<double>")
    assert sorted(r["features"] for r in similarity.masked(motifs).collect()) == [[-1.0, 1.0], [-1.0, 2.0]]
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query long, id long, rank int")
    names = spark.createDataFrame([(10, "A"), (11, "A"), (12, "B")], "id long, molecule string")
    assert [(r["id"], r["place"]) for r in similarity.unique_hits(hits, names, 2).orderBy("place").collect()] == [(10, 1), (12, 2)]
    beta = spark.createDataFrame([("motif_0", "frag", 100.0, 0.8), ("motif_0", "loss", 50.0, 0.01)], "motif string, kind string, mz double, p double")
    assert [(r["feature"], r["color"]) for r in network.feature_edges(beta).collect()] == [("frag_100.0", "red")]
