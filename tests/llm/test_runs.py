"""Periodic runs against a search over all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from peakloom.llm import runs

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """All maximal stretches of each period, kept where no smaller period fits the stretch."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, n, letters):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += rng.choices(letters, k=rng.randint(1, 30))
        else:
            block = rng.choices(letters, k=rng.randint(1, 9))
            if kind > 0.8:
                block = block + block[:1] * rng.randint(1, 7)
            out += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
    return out[:n]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_runs_by_brute_force(letters, monkeypatch):
    rng = random.Random(len(letters))
    texts = [made(rng, rng.randint(0, 160), letters) for _ in range(60)]
    ids = np.array([ord(x) for t in texts for x in t], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    expected = {k: r for k, t in enumerate(texts) if (r := brute(t))}
    for limit in (10**9, 3, 0):  # all words light, some heavy, all heavy
        monkeypatch.setattr(runs, "heavy_from", lambda n, limit=limit: limit)
        for probes in (16, 2, 1):
            monkeypatch.setattr(runs, "PROBES", probes)
            assert runs.runs_by_text(ids, bounds) == expected
    assert len(expected) > 20


def test_lags_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 700)
    for limit in (10**9, 140, 0):
        monkeypatch.setattr(runs, "heavy_from", lambda n, limit=limit: limit)
        counts, base = runs.lag_counts(ids, np.array([0, 300, 300, 700]))
        assert base.tolist() == [0, 76, 77, 178] and counts[[0, 76, 77]].tolist() == [0, 0, 0]
        assert counts[1:76].tolist() == [int((ids[: 300 - p] == ids[p:300]).sum()) for p in range(1, 76)]
        assert counts[78:].tolist() == [int((ids[300 : 700 - p] == ids[300 + p :]).sum()) for p in range(1, 101)]


@pytest.mark.parametrize("block, n", [(1, 300_000), (2, 300_000), (997, 300_000)])
def test_long_texts_of_one_block(block, n):
    ids = np.arange(n) % block
    assert runs.runs_by_text(ids, np.array([0, n])) == {0: [(0, n, block)]}


def test_long_texts_of_few_words_are_bounded(monkeypatch):
    ids = np.random.default_rng(4).integers(0, 2, 60_000)
    ids[20_000:24_000] = np.tile(ids[20_000:20_800], 5)
    scanned = []
    whole = runs.stretches
    monkeypatch.setattr(runs, "stretches", lambda m: (scanned.append(len(m)), whole(m))[1])
    found = runs.runs_by_text(ids, np.array([0, len(ids)]))[0]
    assert [r for r in found if r[2] == 800] and all(r[1] >= max(6, 4 * r[2]) for r in found)
    assert sum(scanned) < 400 * len(ids)  # one whole scan for each lag with enough matches would be 10,000 * n


def test_query_by_brute_force(spark, docs, texts, nothing):
    rng = random.Random(9)
    more = [(100 + k, " ".join(made(rng, rng.randint(0, 120), ["ab", "c", "é日"])), "z") for k in range(80)]
    all_docs = docs.unionByName(spark.createDataFrame([(i, t, None, s, 0) for i, t, s in more], docs.schema))
    expected = []
    for i, t, _ in [*texts, *more]:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = brute(words)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        left = " ".join(x for k, x in enumerate(words) if k not in gone)
        expected.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    out = runs.digest(runs.collapse(all_docs, order=runs.damaged))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert len({x[1] for x in expected}) > 3 and runs.collapse(nothing).count() == 0


def test_odd_columns_and_texts_beyond_a_chunk(spark, monkeypatch):
    from peakloom.llm import textops

    monkeypatch.setattr(textops, "CHUNK_BYTES", 64)
    long = "x y " * 50 + "z"
    docs = spark.createDataFrame([(1, long, 7, "r"), (1, long, 8, "r"), (2, "", 9, "r")], "doc_id long, text string, n_words long, runs string")
    got = sorted(map(tuple, runs.collapse(docs).collect()))
    assert got == [(1, 101, [(0, 100, 2)], "x y z")] * 2 + [(2, 0, [], "")]
    assert next(iter(textops.chunks(pa.array([long])))).n == 1
