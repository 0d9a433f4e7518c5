"""Global ranks, next values and greedy covers, in parts of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import ordered


def test_rows_are_numbered_in_order(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(v, f"r{v}") for v in values], "v int, name string").repartition(7)
    assert [(r["v"], r["n"]) for r in ordered.numbered(df, "v").orderBy("n").collect()] == [(k, k) for k in range(5000)]
    assert [(r["v"], r["place"]) for r in ordered.numbered(df, F.desc("v"), name="place").orderBy("place").limit(3).collect()] == [(4999, 0), (4998, 1), (4997, 2)]
    empty = ordered.numbered(df.limit(0), "v")
    assert empty.count() == 0 and empty.columns == ["v", "name", "n"]
    tied = ordered.numbered(df.withColumn("v", F.lit(1)), "v", "name").orderBy("n").select("name").limit(2).collect()
    assert [r[0] for r in tied] == ["r0", "r1"]


def test_numbering_needs_no_window(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert "Window" not in ordered.numbered(df, "v", "id")._jdf.queryExecution().toString()


def test_next_values(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 4000, 900)).astype(float)
    ahead = x + rng.integers(0, 300, len(x))
    asked = spark.createDataFrame(list(zip(x.tolist(), ahead.tolist(), strict=True)), "x double, ahead double").repartition(6)
    got = dict(map(tuple, ordered.next_values(asked, asked.select("x")).collect()))
    for v, a in zip(x.tolist(), ahead.tolist(), strict=True):
        later = x[x >= a]
        assert got[v] == (later[0] if len(later) else None)


def greedy(x, reach):
    kept, free = [], -np.inf
    for v, r in sorted(zip(x, reach, strict=True)):
        if v >= free:
            kept.append(v)
            free = v + r
    return kept


@pytest.mark.parametrize("kind", ["even", "clusters", "ppm", "far", "nothing"])
def test_cover_in_parts(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.arange(4000) / 100 + 1 if kind == "even" else np.concatenate([rng.normal(c, 0.2, 400) for c in (5, 6, 40, 90, 90.5)]) if kind == "clusters" else rng.uniform(1, 200, 3000)
    reach = x * 0.004 if kind == "ppm" else np.full(len(x), {"far": 150.0, "nothing": 0.0}.get(kind, 0.37))
    points = spark.createDataFrame(list(zip(x.tolist(), reach.tolist(), strict=True)), "x double, reach double").repartition(5)
    expected = greedy(x.tolist(), reach.tolist())
    assert sorted(r["x"] for r in ordered.cover(points).collect()) == expected
    monkeypatch.setattr(ordered, "PART_ROWS", 400)
    assert sorted(r["x"] for r in ordered.cover(points).collect()) == expected


def test_no_group_of_a_gapless_line_grows_with_it(spark, monkeypatch, tmp_path):
    """Every group that a task works on is logged: none has more rows than PART_ROWS."""
    monkeypatch.setattr(ordered, "PART_ROWS", 500)
    real, folder = ordered.walk, str(tmp_path)

    def logged(x, reach, start):
        with open(f"{folder}/{x[0]}", "w") as f:
            f.write(str(len(x)))
        return real(x, reach, start)

    monkeypatch.setattr(ordered, "walk", logged)
    n = 6000
    points = spark.range(n).select((F.col("id") / 1000.0).alias("x"), F.lit(0.05).alias("reach"))  # no gap as wide as the reach
    assert ordered.cover(points).count() == 120
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) == n and len(sizes) >= 20 and max(sizes) <= 500
