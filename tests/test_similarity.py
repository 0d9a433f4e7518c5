"""Blocks of pairs, shared or dealt, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import similarity as S


def sets_of(rng, n, width, share):
    return [sorted(np.flatnonzero(rng.random(width) < share).tolist()) for _ in range(n)]


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("shared", [1 << 26, 0])
@pytest.mark.parametrize("width, share, least", [(64, 0.5, 0.5), (300, 0.03, 0.2), (70, 0.2, 1.0)])
def test_screen_by_brute_force(spark, monkeypatch, shared, width, share, least):
    monkeypatch.setattr(S, "SHARED_BYTES", shared)
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(width)
    a, b = sets_of(rng, 90, width, share), sets_of(rng, 70, width, share)
    b[:5], a[5], b[6], b[7] = a[:5], [], [], [width - 1]
    left = spark.createDataFrame(list(enumerate(a)), "a long, set array<int>").repartition(3)
    right = spark.createDataFrame(list(enumerate(b)), "b long, set array<int>").repartition(3)
    expected = {(i, j): t for i, x in enumerate(a) for j, y in enumerate(b) if (t := tanimoto(x, y)) >= least}
    got = {(r["a"], r["b"]): r["score"] for r in S.screen(left, right, least).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    monkeypatch.setattr(S, "DENSE_BITS", 10)  # as sets
    assert {(r["a"], r["b"]) for r in S.screen(left, right, least).collect()} == {k for k in expected if a[k[0]]}


def test_size_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 10)
    counts = {1: 3, 2: 4, 3: 4, 5: 35, 6: 1, 7: 9, 8: 10}
    places = S.size_parts(counts)
    rows = {}
    for size, (part, several) in places.items():
        for p in range(part, part + several):
            rows[p] = rows.get(p, 0) + counts[size] / several
    assert sorted(rows) == list(range(len(rows))) and max(rows.values()) <= 10


def test_pairs_beyond_the_size_bound_meet_in_no_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "SHARED_BYTES", 0)
    sets = spark.createDataFrame([(k, list(range(k % 32 + 1))) for k in range(128)], "a long, set array<int>")
    met = []
    real = S.matched
    monkeypatch.setattr(S, "matched", lambda *a: (met.extend(a[-1]), real(*a))[1])
    assert S.screen(sets, sets.withColumnRenamed("a", "b"), 0.9).count() == sum(16 for i in range(1, 33) for j in range(1, 33) if min(i, j) >= 0.9 * max(i, j))
    assert len(met) < 32 * 32 / 4


@pytest.mark.parametrize("shared", [1 << 26, 0])
@pytest.mark.parametrize("n, m", [(80, 50), (30, 60)])
def test_cosines_by_brute_force(spark, monkeypatch, shared, n, m):
    monkeypatch.setattr(S, "SHARED_BYTES", shared)
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(n)
    x, q = rng.integers(-2, 3, (n, 5)).astype(float), rng.integers(-2, 3, (m, 5)).astype(float)
    q[0] = 0
    library = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query long, v array<double>")
    unit = lambda v: v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    cosine = np.array([[sum(a * b for a, b in zip(p, r, strict=True)) for r in unit(x).tolist()] for p in unit(q).tolist()])
    got = {(r["query"], r["rank"]): r["score"] for r in S.cosine_top(library, queries, 4).collect()}
    assert len(got) == 4 * m and all(got[k, i + 1] == pytest.approx(s, abs=1e-12) for k in range(m) for i, s in enumerate(sorted(cosine[k], reverse=True)[:4]))
    pairs = {(r["query"], r["id"]) for r in S.cosine_pairs(library, queries, 0.45).collect()}
    assert pairs == {(int(a), int(b)) for a, b in np.argwhere(cosine >= 0.45)}
    assert S.cosine_top(library.limit(0), queries, 4).count() == 0 and S.cosine_top(library, queries.limit(0), 4).count() == 0
    assert S.cosine_top(library, queries.filter(F.col("query") == 1), 4).count() == 4
