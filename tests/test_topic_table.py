"""Topic training with a table partitioned by word, against the one that tasks hold whole."""

import numpy as np
import pytest

from peakloom.operators import lda, topic_table
from peakloom.operators import vectors as V


@pytest.fixture(scope="module")
def corpus(spark):
    cells, _ = lda.synthetic_corpus(spark, 120, seed=3)
    words = [f"w{k:02d}" for k in range(20)]  # two words in no document
    ids = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, id bigint")
    named = cells.join(ids, "word").select("doc", "id", "n")
    return named.persist(), words, ids


def models(spark, corpus):
    cells, words, ids = corpus
    rng = np.random.default_rng(7)
    lam = rng.gamma(100.0, 0.01, (3, 20))
    lam[:, 18:] = 0.01
    rows = spark.createDataFrame([(k, lam[:, k].tolist()) for k in range(18)], "id bigint, v array<double>")
    return lda.TopicModel(lam, np.full(3, 0.1), words), topic_table.given(rows, 20, np.full(3, 0.1))


@pytest.mark.parametrize("size", [1 << 22, 600])
def test_rounds_equal_those_of_the_whole_table(spark, corpus, size, monkeypatch):
    monkeypatch.setattr(topic_table, "BLOCK_CELLS", size)
    cells, words, ids = corpus
    whole, parted = models(spark, corpus)
    assert parted.totals == pytest.approx(whole.lam.sum(axis=1))
    docs = lda.bags(cells.join(ids, "id").select("doc", "word", "n"), ids)
    whole = lda.fit(docs, words, 3, epochs=3, start=whole, learn_alpha=True, tol=0.0)
    parted = topic_table.fit(cells, parted, epochs=3, learn_alpha=True, tol=0.0)
    assert parted.history == pytest.approx(whole.history, rel=1e-6) and parted.alpha == pytest.approx(whole.alpha, rel=1e-5)
    for a, b in zip(parted.checks, whole.checks, strict=True):
        assert {k: a[k] for k in b} == pytest.approx(b, rel=1e-5)
    got = {(r["topic"], r["word"]): r["p"] for r in topic_table.table(parted, ids).collect()}
    expected = {(k, w): whole.beta[k, j] for k in range(3) for j, w in enumerate(words)}
    assert got == pytest.approx(expected, rel=1e-4, abs=1e-7)
    mixtures = {(r["doc"], r["topic"]): r["p"] for r in topic_table.infer(cells, parted).collect()}
    assert mixtures == pytest.approx({(r["doc"], r["topic"]): r["p"] for r in lda.infer(docs, whole).collect()}, abs=1e-3)


def test_a_vocabulary_beyond_the_whole_tables_limit_trains(spark):
    """150,000 words by 800 topics are more cells than lda.fit takes."""
    vocabulary, topics = 150_000, 800
    with pytest.raises(ValueError, match="cells"):
        lda.fit(spark.createDataFrame([], "doc bigint, ids array<int>, counts array<bigint>"), [""] * vocabulary, topics)
    cells = spark.range(3000).selectExpr("id % 60 as doc", "(id * 7919) % 150000 as id", "1 + id % 3 as n")
    model = topic_table.fit(cells, topic_table.start(cells, vocabulary, topics), epochs=2, steps=3)
    assert len(model.history) == 2 and model.rows.count() == 3000
    assert model.totals.sum() == pytest.approx(topics * vocabulary * 0.01 + 6000, rel=1e-6)
    assert model.checks[0]["table"] > model.checks[1]["table"] > 0


def test_training_stops_when_table_and_prior_rest(spark, corpus):
    cells, _, _ = corpus
    model = topic_table.fit(cells, topic_table.start(cells, 20, 3, seed=2), epochs=60, tol=0.02)
    assert len(model.history) < 60 and all(c["table"] < 0.02 for c in model.checks[-2:])
    again = topic_table.fit(cells, model, epochs=len(model.history))
    assert again.history == model.history  # its epochs count
    assert topic_table.fit(cells.limit(0), topic_table.start(cells.limit(0), 20, 3), epochs=1).history == [0.0]


def test_vectors_are_summed_by_key(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 40)
    rng = np.random.default_rng(5)
    rows = [(k % 7 if k % 11 else None, rng.integers(0, 9, 4).astype(float).tolist() if k % 13 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(6)
    got = {r["k"]: r["v"] for r in V.vector_sums(df, "k").collect()}
    for key in {k for k, _ in rows}:
        assert got[key] == np.sum([v for k, v in rows if k == key and v], axis=0).tolist()
    assert len(got) == 8 and V.vector_sums(df.limit(0), "k").count() == 0
    named = {r["name"]: r["v"] for r in V.vector_sums(df.selectExpr("concat('n', k) as name", "v"), "name").collect()}
    assert named["n3"] == got[3]
