"""Periodic runs of words: stretches that repeat a block of q words four times or more.

A run is a stretch of consecutive words with smallest period q, of at least max(least, exponent * q) words, that no word beside
it extends. Lags are counted before any text is scanned, heavy words apart from light ones:

1. light words, which a text has at most sqrt(n log n) times: the differences of their places, up to n / exponent, are counted pair
   by pair, all texts of a chunk at a time;
2. heavy words: exact autocorrelation by FFT, two words in a transform, rounded to whole numbers;
3. only a lag p with at least max(least, exponent * p) - p matches is scanned for islands of them. Lags are taken in
   ascending order, and the matches that found runs explain at multiples of their periods are taken off first: inside a run of period p
   no run of a period dividing p is longer than p words, so what is left still shows every new run, and a text of one word is scanned once.
   An island of a large lag holds many equally spaced places, which are tried before the words between them.

So a text of n words costs about n log n for each heavy word, and at most n sqrt(n log n) pairs. Every text is worked on by
itself where it lies: nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; a null key is a key like any other; repeated rows and rows that share a
key are texts of their own; of runs of one length the first, then that of the smaller period, is the longest; an empty table gives an
empty result; other columns are not read, whatever their names. Words are equal if their 64-bit hashes are. A text is
held whole, with some 150 bytes a word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import documents, quoted

LEAST, EXPONENT = 6, 4
PROBES = 16  # places tried in each period of a large lag
Run = tuple[int, int, int]


def heavy_from(n: int) -> int:
    """Words more frequent than this in a text of n words are heavy."""
    return max(64, math.isqrt(int(n * math.log2(max(n, 2)))))


def lag_counts(ids: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """How many places of each text equal the word `lag` words on, for lags up to n / exponent, flat, and where each text's lag 0 is."""
    n = np.diff(bounds)
    top = n // exponent
    base = np.concatenate([[0], np.cumsum(top + 1)])
    counts = np.zeros(base[-1], dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    key = owner * (int(ids.max(initial=0)) + 1) + ids
    at = np.argsort(key, kind="stable")
    word = key[at]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(word)))
    limits = np.array([heavy_from(x) for x in n.tolist()], dtype=np.int64)
    heavy = sizes > limits[owner[at[first]]]
    light = np.repeat(~heavy, sizes)
    for text in np.unique(owner[at[first[heavy]]]).tolist() if heavy.any() else []:
        chosen = np.flatnonzero(heavy & (owner[at[first]] == text))
        places = [at[first[g] : first[g] + sizes[g]] - bounds[text] for g in chosen.tolist()]
        counts[base[text] : base[text + 1]] += autocorrelation(places, int(n[text]), int(top[text]))
    word, at = word[light], at[light]
    live, j = np.arange(len(word)), 1
    while len(live):  # pairs of the j-th next place of the same word; beyond the largest lag, later ones are too
        live = live[live + j < len(word)]
        live = live[word[live + j] == word[live]]
        lag, text = at[live + j] - at[live], owner[at[live]]
        near = lag <= top[text]
        live, slot = live[near], (base[text] + lag)[near]
        if 8 * len(slot) > len(counts):
            counts += np.bincount(slot, minlength=len(counts))
        else:
            np.add.at(counts, slot, 1)
        j += 1
    return counts, base


def autocorrelation(places: list[np.ndarray], n: int, top: int) -> np.ndarray:
    """Pairs of places of one word, over all words, at lags 0 to top; lag 0 is left 0."""
    size = 1 << (n + top).bit_length()
    power = np.zeros(size)
    for a in range(0, len(places), 2):
        wave = np.zeros(size, dtype=np.complex128)
        wave[places[a]] = 1
        if a + 1 < len(places):
            wave[places[a + 1]] = 1j  # the real part of the product is the sum of both words' counts
        wave = np.fft.fft(wave)
        power += wave.real**2 + wave.imag**2
    out = np.rint(np.fft.ifft(power).real[: top + 1]).astype(np.int64)
    out[0] = 0
    return out


def stretches(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(match.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """Maximal stretches (first, behind the last) of at least `need` places that equal the word `lag` words on."""
    n, step = len(ids) - lag, max(1, lag // PROBES)
    starts, ends = stretches(ids[:n:step] == ids[lag::step])
    wide = ends - starts >= need // step
    if step == 1:
        return list(zip(starts[wide].tolist(), ends[wide].tolist(), strict=True))
    out = []
    for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
        low, high = max(0, (s - 1) * step + 1), min(n, e * step)
        a, b = stretches(ids[low:high] == ids[low + lag : high + lag])
        out += [(low + x, low + y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y - x >= need]
    return out


def runs_of(ids: np.ndarray, lags: list[int], counts: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """The runs (start, length, period) of a text, by start and period, from its lags with enough matches, ascending."""
    out: list[Run] = []
    explained = np.zeros(len(ids) // exponent + 1, dtype=np.int64)
    seen = set()
    for lag, count in zip(lags, counts, strict=True):
        need = max(least, exponent * lag) - lag
        if count - explained[lag] < need:
            continue
        for s, e in islands(ids, lag, need):
            length = e + lag - s
            if (s, length) not in seen:  # else a multiple of that stretch's smallest period
                seen.add((s, length))
                out.append((s, length, lag))
                multiples = np.arange(2 * lag, min(len(explained) - 1, length - 1) + 1, lag)
                explained[multiples] += length - multiples
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_text(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> dict[int, list[Run]]:
    """The runs of each text that has any."""
    counts, base = lag_counts(ids, bounds, exponent)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    found = np.flatnonzero((lag > 0) & (counts >= np.maximum(least, exponent * lag) - lag))
    cuts = np.searchsorted(found, base)
    out = {}
    for text in np.flatnonzero(np.diff(cuts)).tolist():
        at = found[cuts[text] : cuts[text + 1]]
        if runs := runs_of(ids[bounds[text] : bounds[text + 1]], lag[at].tolist(), counts[at].tolist(), least, exponent):
            out[text] = runs
    return out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs, by start and period, and what is left, joined by one space, once every run
    keeps its first period only.

    order: for a key and its number of words, the words to look at, as numbers of the text's own; None leaves them as they are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b["doc_id"].to_pylist()
            for w in T.chunks(b["text"]):
                take = np.arange(len(w.hashes))
                for d in range(w.n) if order else []:
                    own = order(keys[w.first + d], int(w.bounds[d + 1] - w.bounds[d]))
                    if own is not None:
                        take[w.bounds[d] : w.bounds[d + 1]] = w.bounds[d] + own
                ids = np.unique(w.hashes, return_inverse=True)[1][take]
                found = runs_by_text(ids, w.bounds, least, exponent)
                raw, kept = w.data.tobytes(), []
                for d in range(w.n):
                    at = take[w.bounds[d] : w.bounds[d + 1]]
                    if d in found:
                        depth = np.zeros(len(at) + 1, dtype=np.int64)
                        for s, length, period in found[d]:
                            depth[s + period] += 1
                            depth[s + length] -= 1
                        at = at[np.cumsum(depth[:-1]) == 0]
                    kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]).decode())
                flat = np.array([r for d in sorted(found) for r in found[d]], dtype=np.int64).reshape(-1, 3)
                bounds = np.concatenate([[0], np.cumsum([len(found.get(d, ())) for d in range(w.n)])])
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(w.first, w.n), pa.array(w.counts.astype(np.int64)), runs, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text")).mapInArrow(rows, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def damaged(key: int | None, n: int) -> np.ndarray | None:
    """The contract's damage: in one of ten texts the words from a place on become repeats of a block."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return out


def digest(found: DataFrame) -> DataFrame:
    """collapse()'s rows with the longest run's numbers and hashes in place of runs and texts."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("longest", longest).withColumns({"start": -F.col("longest.start"), "length": F.col("longest.length"), "period": -F.col("longest.period")})
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(F.col("length") * 1000 / F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(collapse(documents(spark, sf_dir), order=damaged))
