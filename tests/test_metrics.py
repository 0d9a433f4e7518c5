import random

import itertools
import math

import numpy as np
import pytest

from peakloom.operators import metrics


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (4, 6)])
def test_assignment_is_cheapest(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.normal(size=shape)
        pairs = metrics.assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(shape[0])) for p in itertools.permutations(range(shape[1]), shape[0]))
        assert len({j for _, j in pairs}) == shape[0] and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_matched_topics():
    a = np.array([[1.0, 0, 0], [0, 1, 0]])
    assert metrics.matched_topics(a, a[::-1]) == [(0, 1, 1.0), (1, 0, 1.0)]


def test_distances(spark):
    a = spark.createDataFrame([("x", 0, 1.0)], "doc string, topic int, p double")
    b = spark.createDataFrame([("x", 1, 1.0)], "doc string, topic int, p double")
    r = metrics.mixture_distances(a, b).first()
    assert r["cosine"] == 0 and r["js"] == pytest.approx(math.log(2))
    assert metrics.mixture_distances(a, a).first()["cosine"] == pytest.approx(1)


def test_splits_do_not_leak(spark):
    sizes = {f"g{k}": k + 1 for k in range(20)}
    split = metrics.group_split(sizes, {"train": 0.8, "test": 0.2}, 1)
    assert abs(sum(sizes[g] for g in sizes if split[g] == "train") / sum(sizes.values()) - 0.8) < 0.05
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "k string, split string")
    assert [r["k"] for r in metrics.leakage(df, "k").collect()] == ["a"]


def test_group_split_by_brute_force(spark):
    """The rule step by step: least relative overshoot, then most missing, then digest."""
    import hashlib
    import random

    digest = lambda text: hashlib.sha256(f"5\0{text}".encode()).hexdigest()
    for seed in range(30):
        rng = random.Random(seed)
        sizes = {f"g{k}": rng.randint(1, 30) for k in range(rng.randint(1, 25))}
        shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
        have, want = dict.fromkeys(shares, 0), {s: x * sum(sizes.values()) for s, x in shares.items()}
        expected = {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], digest(g))):
            ranked = []
            for s in shares:
                over = have[s] + sizes[g] - want[s]
                ranked.append((max(over, 0.0) / max(want[s], 1.0), -(want[s] - have[s]) / max(want[s], 1.0), digest(f"{g}\0{s}"), s))
            expected[g] = min(ranked)[3]
            have[expected[g]] += sizes[g]
        assert metrics.group_split(sizes, shares, 5) == expected
    rows = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "g string, k int")
    out = metrics.split_by_group(rows, "g", shares, 5).collect()
    assert len(out) == sum(sizes.values()) and all(r["split"] == expected[r["g"]] for r in out)


SPLITS = [{"train": 0.7, "validation": 0.15, "test": 0.15}, {"train": 0.5, "test": 0.5}, {"a": 0.31, "b": 0.3, "c": 0.2, "d": 0.19}, {"all": 1.0}]


@pytest.mark.parametrize("shares", SPLITS)
def test_slots_are_those_of_the_greedy_rule(shares):
    rng = random.Random(len(shares))
    for _ in range(60):
        have = [rng.randint(0, 40) for _ in shares]
        total, size, n = sum(have) + rng.randint(1, 300), rng.randint(1, 9), rng.randint(0, 40)
        slots = metrics.Slots(list(shares.values()), total, have, size, 3)
        groups = [f"g{rng.random()}" for _ in range(n)]
        taken = [0] * len(shares)
        whole = slots.deal(taken, groups, list(shares))
        for k in range(n + 1):
            begin, state = slots.after(k)
            assert begin <= k < begin + len(shares) and [whole[:begin].count(s) for s in range(len(shares))] == state
            assert slots.deal(state, groups[begin:], list(shares)) == whole[begin:]


@pytest.mark.parametrize("shares", SPLITS)
@pytest.mark.parametrize("chunk", [10_000, 7, 1])
def test_groups_are_split_apart_as_one_after_the_other(spark, shares, chunk, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK", chunk)
    rng = random.Random(chunk)
    sizes = {f"g{k}": rng.choice([1, 1, 1, 2, 2, 3, 5, 30 + k % 4]) for k in range(90)}
    rows = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)] + [(None, 0)], "g string, k int").repartition(5)
    out = metrics.split_by_group(rows, "g", shares, 3).collect()
    assert len(out) == sum(sizes.values())
    assert {r["g"]: r["split"] for r in out} == metrics.group_split(sizes, shares, 3)
    assert metrics.split_by_group(rows.limit(0), "g", shares, 3).count() == 0
