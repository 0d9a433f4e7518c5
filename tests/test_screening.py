import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import sketches
from peakloom.operators import screening, summaries


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_overlap_screen_takes_the_first_match(spark):
    motifs = frame(spark, [("m", 100.0, 0.5), ("m", 200.0, 1.0), ("m", 300.0, 0.5)], "motif string, mz double, i double")
    spectra = frame(spark, [("s", 99.998, 5.0), ("s", 100.001, 50.0), ("s", 200.0, 10.0), ("t", 900.0, 1.0)], "spectrum string, mz double, i double")
    r = screening.overlap_screen(motifs, spectra).collect()
    assert [(x["motif"], x["spectrum"], x["n"], x["total"], x["grade"]) for x in r] == [("m", "s", 2, 1.5, "C")]
    assert r[0]["r"] == pytest.approx(1.0)
    assert screening.overlap_screen(motifs, spectra.limit(0)).count() == 0
    level = screening.overlap_screen(motifs, frame(spark, [("s", 100.0, 5.0), ("s", 200.0, 5.0)], "spectrum string, mz double, i double")).first()
    assert (level["n"], level["r"], level["grade"]) == (2, 0.0, "D")
    one = screening.overlap_screen(motifs, frame(spark, [("s", 100.0, 5.0)], "spectrum string, mz double, i double")).first()
    assert (one["n"], one["grade"]) == (1, None)
    kinds = "motif string, kind string, mz double, i double"
    m = frame(spark, [("m", "frag", 100.0, 0.4), ("m", "loss", 18.01, 0.6), ("m", "loss", 44.0, 0.1)], kinds)
    s = frame(spark, [("s", "frag", 18.01, 1.0), ("s", "loss", 18.018, 3.0), ("s", "frag", 100.004, 2.0), ("s", "loss", 44.011, 1.0)], kinds.replace("motif", "spectrum"))
    assert [(x["n"], x["total"], x["grade"]) for x in screening.overlap_screen(m, s).collect()] == [(2, 1.0, "C")]


def test_grades(spark):
    from peakloom.functions.scalars import grade

    cases = [(3, 0.9, 0.7, "A"), (3, 0.9, 0.69, "B"), (3, 0.9, 0.5, "B"), (3, 0.9, 0.49, "C"), (3, 0.89, 0.9, "C"), (2, 0.5, 0.3, "C"), (2, 0.8, 0.2, "D"), (2, 0.79, 0.2, None), (1, 5.0, 1.0, None), (9, 0.4, 1.0, None)]
    df = frame(spark, cases, "n int, t double, r double, want string")
    assert all(r["g"] == r["want"] for r in df.withColumn("g", grade(F.col("n"), F.col("t"), F.col("r"))).collect())


def test_near_is_complete(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 3, 200), rng.uniform(0, 3, 200)
    left, right = frame(spark, [(float(x),) for x in a], "a double"), frame(spark, [(float(x),) for x in b], "b double")
    assert screening.near(left, right, "a", "b", 0.01).count() == int((np.abs(a[:, None] - b[None, :]) <= 0.01).sum())


def test_optimised_keeps_what_every_hit_has(spark):
    hits = frame(spark, [("m", 1, "frag", 100.001), ("m", 2, "frag", 100.002), ("m", 1, "frag", 50.0), ("m", 1, "loss", 18.01), ("m", 2, "loss", 18.01)], "motif string, hit int, kind string, mz double")
    own = frame(spark, [("m", "frag", 100.0, 0.5), ("m", "frag", 50.0, 0.1), ("m", "loss", 18.01, 0.2), ("m", "loss", 100.0, 0.2)], "motif string, kind string, mz double, i double")
    assert {(r["kind"], r["mz"]) for r in screening.optimised(own, hits).collect()} == {("frag", 100.0), ("loss", 18.01)}


def test_same_float(spark):
    left = frame(spark, [("d", 100.1, 1), ("d", 5.0, 2), ("d", 5.0, 3)], "doc string, mz double, x int")
    right = frame(spark, [("d", float(np.float32(100.1)), 9), ("d", 5.0, 8)], "doc string, mz double, y int")
    assert [(r["x"], r["y"]) for r in screening.same_float(left, right, ["doc"]).collect()] == [(1, 9)]


def brute_linkage(similarity, cut):
    rows = 1 - np.asarray(similarity, float)
    far = np.linalg.norm(rows[:, None] - rows[None, :], axis=2)
    groups = [[k] for k in range(len(rows))]
    while len(groups) > 1:
        d, a, b = min((far[np.ix_(groups[a], groups[b])].max(), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if d > cut:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(10))
def test_complete_linkage(seed):
    rng = np.random.default_rng(seed)
    s = rng.uniform(size=(9, 9))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    for cut in (0.0, 0.6, 0.9, 1.3, 9.0):
        labels = screening.complete_linkage(s, cut)
        assert {frozenset(np.flatnonzero(labels == x).tolist()) for x in set(labels.tolist())} == brute_linkage(s, cut)


def test_clustered_and_selected_hits(spark):
    score = [[1, 0.1, 0.1], [0.1, 1, 0.95], [0.1, 0.95, 1]]
    pairs = frame(spark, [("m", a + 1, b + 1, float(score[a][b])) for a in range(3) for b in range(3)], "motif string, rank int, other int, score double")
    clusters = screening.clustered_hits(pairs, 0.3)
    assert sorted(r["rank"] for r in screening.selected_hits(clusters).collect()) == [1]
    assert sorted(r["rank"] for r in screening.selected_hits(clusters, "biggest").collect()) == [2, 3]
    with pytest.raises(ValueError):
        screening.selected_hits(clusters, "worst")


def test_greedy_cosine(spark):
    pairs = frame(spark, [(1, 2)], "a int, b int")
    left = frame(spark, [(1, 100.0, 3.0), (1, 100.05, 4.0)], "a int, mz double, i double")
    right = frame(spark, [(2, 100.02, 5.0)], "b int, mz double, i double")
    r = screening.greedy_cosine(pairs, left, right).first()
    assert (r["n"], r["score"]) == (1, pytest.approx(0.8))
    r = screening.greedy_cosine(pairs, left, left.withColumnRenamed("a", "b").withColumn("b", F.lit(2))).first()
    assert (r["n"], r["score"]) == (2, pytest.approx(1.0))


def test_search_without_a_number(spark):
    s = frame(spark, [("a", 300.0, 100.0, None), ("b", 400.0, 50.0, 100.0)], "scan string, precmz double, frag_mz double, loss_mz double")
    found = lambda *a, **k: sorted(r["scan"] for r in screening.search(s, *a, **k).collect())
    assert found(300, 400) == ["a", "b"] and found(0, 1000, "abc") == []
    assert found(0, 1000, "100") == ["a"] and found(0, 1000, "100", losses=True) == ["a", "b"] and found(301, 400, "100") == []


def test_summaries(spark):
    h = frame(spark, [(k, v) for k, v in enumerate([10.0, 5.0, 4.99, 4.98, 9.0])], "step int, value double")
    assert [r["stable"] for r in summaries.converged(h, 0.01, 2).orderBy("step").collect()] == [False, False, False, True, False]
    a = summaries.audit(frame(spark, [("x",), ("x",), (None,), ("y",)], "k string"), "k").first()
    assert tuple(a) == (4, 2, 1, 1, 1) and tuple(summaries.audit(frame(spark, [], "k string"), "k").first()) == (0, 0, 0, 0, 0)
    t = summaries.latencies(frame(spark, [("a", 1.0, 2), ("a", 3.0, 2)], "arm string, seconds double, items int"), "arm").first()
    assert (t["median"], t["per_second"]) == (2.0, 1.0)
    v = frame(spark, [("u", [1.0, 2.0], [0.5, 0.5]), ("u", [0.0], [math.nan]), ("w", [1.0], [1.0, 2.0])], "usi string, mz array<double>, values array<double>")
    assert summaries.violations(v, "usi").first().asDict() == {"repeated": 1, "unequal": 1, "not_finite": 1, "not_positive": 1}


def test_sketches(spark):
    maps = sketches.permutations(64)
    df = frame(spark, [("abcdefgh", "abcdefgh"), ("abcdefgh", "zzzzyyyyxxxx"), ("ab", "")], "a string, b string")
    s = df.select(*(sketches.minhash(sketches.lingo(F.col(c)), maps).alias(c) for c in "ab"))
    r = s.select(sketches.distance(F.col("a"), F.col("b")).alias("d"), (sketches.merged(F.col("a"), F.col("b")) == sketches.merged(F.col("b"), F.col("a"))).alias("m")).collect()
    assert r[0]["d"] == 0 and r[1]["d"] > 0.9 and r[2]["d"] == 0 and all(x["m"] for x in r)


def one_by_one(p, q, margin):
    """Greedy matching of one pair, match after match."""
    found = sorted((-x * y, i, j) for i, (a, x) in enumerate(p) for j, (b, y) in enumerate(q) if abs(a - b) <= margin)
    left, right, total = set(), set(), 0.0
    for product, i, j in found:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            total -= product
    norm = math.sqrt(sum(x * x for _, x in p) * sum(y * y for _, y in q))
    return total / norm if norm else 0.0, len(left)


def test_greedy_cosines_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    spectra = [sorted((float(m), float(i)) for m, i in zip(np.round(rng.choice([10, 10.5, 11, 30], n) + rng.uniform(0, 0.4, n), 2), rng.integers(0, 5, n), strict=True)) for n in rng.integers(1, 9, 60)]
    left = frame(spark, [(k, m, i) for k, s in enumerate(spectra[:30]) for m, i in s], "a int, mz double, i double")
    right = frame(spark, [(k, m, i) for k, s in enumerate(spectra[30:]) for m, i in s], "b int, mz double, i double")
    expected = {(a, b): one_by_one(spectra[a], spectra[30 + b], 0.1) for a in range(30) for b in range(30)}
    pairs = frame(spark, list(expected), "a int, b int")
    got = {(r["a"], r["b"]): (r["score"], r["n"]) for r in screening.greedy_cosine(pairs, left, right).collect()}
    assert got.keys() == expected.keys() and all(got[k] == (pytest.approx(s, abs=1e-12), n) for k, (s, n) in expected.items())
    for least in (0.05, 0.5, 0.8, 0.95):
        kept = {k for k, (s, _) in expected.items() if s >= least}
        assert {(r["a"], r["b"]) for r in screening.greedy_search(left, right, least).collect()} == kept
        near = screening.near_pairs(left, right, least).count()
        assert len(kept) <= near <= 900 and (least < 0.9 or near < 500)
    assert screening.greedy_search(left.limit(0), right, 0.5).count() == 0 and screening.greedy_search(left, right.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("block, held", [(100_000, 1 << 22), (60, 1 << 22), (7, 30)])
def test_mean_embeddings_in_blocks(spark, monkeypatch, block, held):
    from peakloom.operators import similarity, vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "AT_ONCE", 16)
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(4)
    table = {f"w{k}": rng.normal(size=5) for k in range(40)}
    cells = [(f"d{d}" if d else None, f"w{w}", int(rng.integers(1, 9))) for d in range(12) for w in rng.choice(50, 6 if d else 45, replace=False)]  # one document is long, ten words have no vector
    got = {}
    for r in similarity.mean_embedding(frame(spark, cells, "doc string, word string, n int"), frame(spark, [(w, v.tolist()) for w, v in table.items()], "word string, v array<double>")).collect():
        got.setdefault(r["doc"], {})[r["pos"]] = r["value"]
    for doc in {d for d, _, _ in cells}:
        own = [(table[w], math.sqrt(n)) for d, w, n in cells if d == doc and w in table]
        assert (doc in got) == bool(own)
        if own:
            assert [got[doc][k] for k in range(5)] == pytest.approx(sum(v * n for v, n in own) / sum(n for _, n in own))
    assert vectors.weighted_means(frame(spark, [], "doc string, word string, w double"), frame(spark, [], "word string, v array<double>")).count() == 0
