"""Language-model scores: a hidden Markov model over all training tokens, beside an add-one unigram base.

Tokens are the lower-cased words of a text and one end. All training tokens are counted, and texts are kept as ranks of
the `head` most frequent tokens, beside a list of each text's rarer ones. The `classes` - 1 most frequent
tokens are classes of their own, all others share the last one while the chain is trained. States are
trained by Baum-Welch: expected counts are summed inside each task, across partitions by a grouped aggregation, and
renormalised; each of the `rounds` rounds takes all training documents, cut into segments of SEGMENT tokens. They start
from a model of `sample` segments. The last round also sums the expected counts by state of every token of the last
class, from which that token gets emissions of its own: in each state, its share of the class is its expected count over
the mean token's, add-one smoothed as the base is. Scoring runs the scaled forward recursion over each whole text, many
texts at a time, so log10 P(text) is exact under the model.

Counts and emissions of the `head` tokens are broadcast (a fixed number); rarer tokens meet theirs in a
shuffle join, once for each text they are in. Tokens are identified by 64-bit hashes. Probabilities inside the training are
single floats, their sums double ones.

Defined cases: null and empty texts are one end; a null doc_id is neither learned from nor held out; repeated rows are each
learned from and scored alike; tokens of equal count are ranked by hash; with no training token every count is 0; an empty
table gives an empty result. Other columns are not read. A text is held whole, with some 60 bytes a token; training takes
BLOCK segments at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import crc_rest, documents, least_hashed, settle

END = np.int64(-0x61C8864680B583EB)
SEGMENT = 128
TOKENS = 1 << 18  # that are worked on at a time, or one text's
BLOCK = 512  # segments that are taken through the chain at a time
SLAB = 4096  # segments after which rare tokens' sums are handed on, if they are many
CHUNK = 1 << 22
HELD_WORDS = 1 << 18
EXACT = 4096  # counts up to it have a level of their own
UNIT = 4096  # expected counts of rare tokens are summed as whole numbers of 1 / UNIT, which take less room


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [w.hashes.view(np.int64) for w in T.chunks(b["text"], lower=True)]
            words, n = np.unique(np.concatenate([*parts, np.full(len(b), END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(rows, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens, by rank, with their counts; total and distinct: of all training tokens; the rest: of the last class."""

    words: np.ndarray
    counts: np.ndarray
    n_classes: int
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int

    def __post_init__(self) -> None:
        # words in order of hash, cut by their leading bits: a look-up reads a few neighbouring places
        self.order = np.argsort(self.words.view(np.uint64)).astype(np.int32)
        self.sorted = self.words.view(np.uint64)[self.order]
        self.shift = np.uint64(64 - max(1, len(self.words).bit_length() + 1))
        self.cuts = np.searchsorted(self.sorted >> self.shift, np.arange((1 << int(64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.widest = int(np.diff(self.cuts).max()) if len(self.words) else 0

    @property
    def base_denominator(self) -> float:
        return float(self.total + self.distinct + 1)

    @property
    def rest_denominator(self) -> float:
        return float(self.rest_total + self.rest_distinct + 1)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's rank, -1 for one that is not among the words."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        hashes = hashes.view(np.uint64)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.cuts[bucket], self.cuts[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.widest):
            place = at[left]
            same = self.sorted[place] == hashes[left]
            out[left[same]] = self.order[place[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def kinds(self, ranks: np.ndarray) -> np.ndarray:
        """The class of each rank: its own for the most frequent ones, the last for all others."""
        return np.where((ranks < 0) | (ranks >= self.n_classes), self.n_classes - 1, ranks)


def vocabulary(counts: DataFrame, head: int, classes: int) -> Vocabulary:
    """The `head` most frequent tokens, ties by hash.

    A histogram of counts (exact ones to EXACT, then steps of a fixed ratio) tells the count at which they end, so only they, and of that
    count only as many as are needed, are gathered: no task sorts `head` rows of every partition.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(EXACT + 1 + F.floor(F.log(F.col("n") / EXACT) * 64)).cast("long")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # some thousands of rows at most
    above, last = 0, 0
    for last in sorted(sizes, reverse=True):
        if above + sizes[last] >= head:
            break
        above += sizes[last]
    wanted = head - above
    edge = counts.filter(level == last)
    if last <= EXACT and sizes.get(last, 0) > 2 * wanted:  # all of one count: the least hashes, which are spread evenly
        edge = least_hashed(edge, F.col("word"), wanted)
    top = counts.filter(level > last).unionByName(edge).select("word", "n").toArrow()
    words, n = (np.array(top[c].to_numpy(), dtype=np.int64) for c in ("word", "n"))
    order = np.lexsort((words, -n))[:head]
    words, n = words[order], n[order]
    return Vocabulary(words, n, classes, total, distinct, int(total - n[: classes - 1].sum()), max(0, distinct - (classes - 1)))


def tokenised(docs: DataFrame, vocab: Broadcast, modulus: int = 7) -> DataFrame:
    """(row, doc_id, learned, tokens, rare), settled: ranks of each text's tokens as 32-bit integers; -1, -2, ... are places in its list of rare tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for w in T.chunks(b["text"], lower=True, size=T.CHUNK_BYTES // 2):
                bounds = w.bounds + np.arange(w.n + 1)
                tokens = np.full(bounds[-1], END)
                tokens[np.arange(len(w.hashes)) + w.owners()] = w.hashes.view(np.int64)
                index = vocab.value.ranks(tokens)
                rare = np.flatnonzero(index < 0)
                owner = np.searchsorted(bounds, rare, side="right") - 1
                order = np.lexsort((tokens[rare], owner))
                rare_words, owner = tokens[rare][order], owner[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (rare_words[1:] != rare_words[:-1])
                first = np.flatnonzero(new)
                cuts = np.searchsorted(owner[first], np.arange(w.n + 1))
                index[rare[order]] = cuts[owner] - np.cumsum(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(part) << 36) + number + np.arange(w.n)),
                        b["doc_id"].slice(w.first, w.n),
                        b["learned"].slice(w.first, w.n),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), w.n, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4)), pa.py_buffer(index)]).cast(pa.binary()),
                        T.lists(rare_words[first], cuts, pa.int64()),
                    ],
                    ["row", "doc_id", "learned", "tokens", "rare"],
                )
                number += w.n

    learned = F.coalesce(crc_rest("doc_id", modulus) != 2, F.lit(False)).alias("learned")
    return settle(docs.select("doc_id", "text", learned).mapInArrow(rows, "row bigint, doc_id bigint, learned boolean, tokens binary, rare array<bigint>"), "hmm-tokens")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of a batch's tokens and the texts' bounds."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.int32), (offsets - offsets[0]) // 4


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows of about TOKENS tokens in all, one row at least: arrays stay small beside a worker."""
    for b in batches:
        ends = np.cumsum(np.diff(np.frombuffer(b["tokens"].buffers()[1], np.int32)[b["tokens"].offset : b["tokens"].offset + len(b) + 1].astype(np.int64)) // 4) if len(b) else np.zeros(0, np.int64)
        at = 0
        while at < len(b):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, side="right")))
            yield b.slice(at, stop - at)
            at = stop


@dataclass
class Model:
    start: np.ndarray  # states
    later: np.ndarray  # of a segment that does not begin a text
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes x states

    def logs(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithm of each sequence's probability, by the scaled forward recursion."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        at, lengths = bounds[:-1][order], lengths[order]
        total = np.zeros(len(order))
        if not len(order):
            return total
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        alpha = np.broadcast_to(self.start, (len(order), len(self.start)))
        for t, n in enumerate(alive.tolist()):
            alpha = alpha[:n] if t == 0 else alpha[:n] @ self.moves
            alpha = alpha * self.emits[classes[at[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out = np.empty(len(order))
        out[order] = total
        return out

    def posteriors(self, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place's probabilities of the states (place, segment, state) and expected moves; kinds: (place, segment), -1 behind the end."""
        length, n = kinds.shape
        states = len(self.start)
        real = kinds >= 0
        table = np.concatenate([self.emits, np.zeros((1, states))]).astype(np.float32)  # -1 is the last row
        start, later, step = (x.astype(np.float32) for x in (self.start, self.later, self.moves))
        seen = table[kinds]
        alpha = np.zeros((length, n, states), dtype=np.float32)
        scale = np.ones((length, n), dtype=np.float32)
        now = np.where(first[:, None], start, later)
        for t in range(length):
            now = (now if t == 0 else now @ step) * seen[t]
            total = now.sum(axis=1)
            scale[t] = np.where(total > 0, total, 1.0)
            now = now / scale[t][:, None]
            alpha[t] = now
        moves = np.zeros((states, states))
        beta = real[length - 1][:, None] * np.ones(states, dtype=np.float32)
        back = np.ascontiguousarray(step.T)
        for t in range(length - 1, -1, -1):
            before = alpha[t - 1] if t else None
            alpha[t] *= beta
            if t:
                ahead = seen[t] * (beta / scale[t][:, None])
                moves += before.T @ ahead
                beta = ahead @ back
                beta[real[t - 1] & ~real[t]] = 1.0
        return alpha, moves * self.moves

    def blocks(self, classes: np.ndarray, first: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Segments BLOCK at a time: which, their classes by place, posteriors and expected moves; memory does not grow with a text."""
        for at in range(0, len(classes), BLOCK):
            part = slice(at, at + BLOCK)
            kinds = np.ascontiguousarray(classes[part].T)
            yield part, kinds, *self.posteriors(kinds, first[part])

    def expected(self, classes: np.ndarray, first: np.ndarray, visit: Callable[[slice, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over segments (rows of classes); visit gets each block's part, classes and posteriors."""
        states = len(self.start)
        start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros_like(self.emits)
        for part, kinds, gamma, between in self.blocks(classes, first):
            mask = kinds >= 0
            symbols, found = kinds[mask].astype(np.int16 if len(emits) < 1 << 15 else np.int64), gamma[mask]
            order = np.argsort(symbols, kind="stable")
            ordered = symbols[order]
            runs = np.flatnonzero(np.diff(ordered, prepend=-1))
            emits[ordered[runs]] += np.add.reduceat(found[order], runs, axis=0, dtype=np.float64)
            start += gamma[0][first[part]].sum(axis=0, dtype=np.float64)
            moves += between
            if visit:
                visit(part, kinds, gamma)
        return start, moves, emits


def initial(classes: int, states: int, share: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    emits = (share[:, None] + 1e-9) * rng.uniform(0.1, 1.9, (classes, states))
    moves = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states) * 0.5
    even = np.full(states, 1 / states)
    return Model(even, even, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def segments(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' classes cut into rows of SEGMENT, -1 behind their ends; whether a row begins a text."""
    rows = -(-np.diff(bounds) // SEGMENT)
    ahead = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(ahead[-1] * SEGMENT, -1, dtype=np.int64)
    out[np.arange(bounds[-1]) + np.repeat(ahead[:-1] * SEGMENT - bounds[:-1], np.diff(bounds))] = kind
    first = np.zeros(ahead[-1], dtype=bool)
    first[ahead[:-1]] = True
    return out.reshape(-1, SEGMENT), first


def renewed(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts, each smoothed a little, emissions towards the classes' shares."""
    start, moves, emits = start + 1, moves + 1, emits + share[:, None] * 10
    later = emits.sum(axis=0)
    return Model(start / start.sum(), later / later.sum(), moves / moves.sum(axis=1, keepdims=True), emits / later)


def sample_segments(tokens: DataFrame, words: Broadcast, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `limit` segments of the training texts, by a hash of their classes; each task hands on those below a cut that leaves about twice as many."""
    learned = tokens.filter("learned").select("tokens")
    there = learned.agg(F.coalesce(F.sum(F.ceil(F.octet_length("tokens") / (4 * SEGMENT))), F.lit(0))).first()[0]
    cut = np.uint64(min(2.0**64 - 1025, 2 * limit / max(there, 1) * 2.0**64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                index, bounds = unpacked(b["tokens"])
                pieces, first = segments(words.value.kinds(index), bounds)
                codes = T.mix64(T.gram_hashes(pieces[:, :16].astype(np.uint64).T.reshape(16, -1), 16)[0])
                few = np.argsort(codes)[:limit]
                few = few[codes[few] <= cut]
                yield pa.RecordBatch.from_arrays([pa.array(codes[few].view(np.int64)), pa.array([x.astype(np.int32).tobytes() for x in pieces[few]], pa.binary()), pa.array(first[few])], ["code", "kinds", "first"])

    found = learned.mapInArrow(rows, "code bigint, kinds binary, first boolean").orderBy("code", "kinds", "first").limit(limit).toArrow()
    return np.frombuffer(b"".join(found["kinds"].to_pylist()), np.int32).reshape(-1, SEGMENT).astype(np.int64), found["first"].to_numpy(zero_copy_only=False).astype(bool)


def by_word(words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and their rows of sums added up."""
    order = np.argsort(words, kind="stable")
    words = words[order]
    runs = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return words[runs], np.add.reduceat(sums[order], runs, axis=0, dtype=np.float64)


def emissions(sums: np.ndarray, rest: np.ndarray, vocab: Vocabulary, model: Model) -> np.ndarray:
    """P(token | state) of tokens of the last class by their expected counts, whose totals are `rest`; 0 for tokens never seen."""
    mean = rest / max(vocab.rest_total, 1)
    return (sums / np.where(mean > 0, mean, 1.0) + 1.0) / vocab.rest_denominator * model.emits[-1]


def train(tokens: DataFrame, vocab: Vocabulary, words: Broadcast, states: int, rounds: int, seed: int = 3, sample: int = 2000, sample_rounds: int = 15) -> tuple[Model, DataFrame, np.ndarray]:
    """Baum-Welch over the training texts: from random parameters to a starting point on `sample` segments, then on all of them.

    Beside the model: (word, n, s0, s1, ...), count and expected counts by state (times UNIT) of the last class's tokens, and their totals by state.
    """
    spark = tokens.sparkSession
    classes = vocab.n_classes
    share = np.zeros(classes)
    share[: min(len(vocab.counts), classes - 1)] = vocab.counts[: classes - 1]
    share[classes - 1] = vocab.rest_total
    share = (share + 1) / (share.sum() + classes)
    model, few = initial(classes, states, share, seed), sample_segments(tokens, words, sample)
    for _ in range(sample_rounds if len(few[0]) else 0):
        model = renewed(*model.expected(*few), share)
    schema = "item int, word bigint, n bigint, " + ", ".join(f"s{k} double, u{k} bigint" for k in range(states))

    def of_classes(sums: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(sums), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), none, none, *(x for s in sums.T for x in (pa.array(np.ascontiguousarray(s)), none))], fields)

    def of_words(found: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        none, whole = pa.nulls(len(sums), pa.float64()), np.rint(sums * np.array([1] + [UNIT] * states)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.int32()), pa.array(found), pa.array(np.ascontiguousarray(whole[:, 0])), *(x for s in whole.T[1:] for x in (none, pa.array(np.ascontiguousarray(s))))], fields)

    fields = [x.split(" ")[0] for x in schema.split(", ")]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, last=turn == rounds - 1) -> Iterator[pa.RecordBatch]:
            now, vocab, total = shared.value, words.value, None
            held: list[tuple[np.ndarray, np.ndarray]] = []
            merged = lambda: by_word(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for b in slices(batches):
                index, bounds = unpacked(b["tokens"])
                cut, first = segments(vocab.kinds(index), bounds)
                named = None
                if last:
                    names = np.zeros(len(index), dtype=np.int64)
                    names[index >= 0] = vocab.words[index[index >= 0]]
                    rare = np.flatnonzero(index < 0)
                    at = b["rare"].offsets.to_numpy()[np.searchsorted(bounds, rare, side="right") - 1] - b["rare"].offsets[0].as_py()
                    names[rare] = b["rare"].flatten().to_numpy()[at - 1 - index[rare]]
                    named = segments(names, bounds)[0]

                def of_rest(part: slice, kinds: np.ndarray, gamma: np.ndarray, named=named) -> None:
                    rest = kinds == vocab.n_classes - 1
                    if rest.any():
                        own = gamma[rest]
                        held.append(by_word(named[part].T[rest], np.concatenate([np.ones((len(own), 1), np.float32), own], axis=1)))

                for at in range(0, len(cut), SLAB):
                    slab = slice(at, at + SLAB)
                    visit = (lambda part, kinds, gamma, at=at: of_rest(slice(at + part.start, at + part.stop), kinds, gamma)) if last else None  # noqa: B023
                    found = np.concatenate([x.reshape(-1, states) for x in now.expected(cut[slab], first[slab], visit)])
                    total = found if total is None else total + found
                    if sum(len(x) for x, _ in held) > HELD_WORDS:
                        yield of_words(*merged())
                        held.clear()
            if held:
                yield of_words(*merged())
            if total is not None:
                yield of_classes(total)

        # one row for each class and state, whatever the number of documents; in the last round one for each token too
        rows = tokens.filter("learned").select("tokens", "rare" if turn == rounds - 1 else F.lit(None).alias("rare")).mapInArrow(sums, schema).groupBy("item", "word").agg(*(F.sum(x).alias(x) for x in fields[2:]))
        if turn == rounds - 1:
            rows = settle(rows, "hmm-lexicon")
        found = rows.filter("item is not null").orderBy("item").toArrow()
        if found.num_rows:
            total = np.stack([found[f"s{k}"].to_numpy() for k in range(states)], axis=1)
            model = renewed(total[0], total[1 : 1 + states], total[1 + states :], share)
    lexicon = rows.filter("item is null").select("word", "n", *(F.col(f"u{k}").alias(f"s{k}") for k in range(states)))
    rest = np.array(lexicon.agg(*(F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(states))).first(), dtype=float)
    return model, lexicon, rest


def score(docs: DataFrame, head: int = 1 << 18, classes: int = 1024, states: int = 8, rounds: int = 3, modulus: int = 7) -> DataFrame:
    """docs (doc_id, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = settle(token_counts(docs.filter(crc_rest("doc_id", modulus) != 2)), "hmm-counts")
    vocab = vocabulary(counts, head, classes)
    words = spark.sparkContext.broadcast(vocab)
    texts = tokenised(docs, words, modulus)
    model, lexicon, rest = train(texts, vocab, words, states, rounds)
    numbers = lambda b: np.stack([b[f"s{k}"].to_numpy() for k in range(states)], axis=1)

    def of_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(words.value.ranks(b["word"].to_numpy()) >= 0))

    top = lexicon.mapInArrow(of_head, lexicon.schema).toArrow()
    own = min(classes - 1, len(vocab.words))  # ranks that are classes of their own
    sums = np.zeros((len(vocab.words), states))
    sums[vocab.ranks(np.array(top["word"].to_numpy(), dtype=np.int64))] = numbers(top)
    table = np.concatenate([model.emits[:own], emissions(sums[own:], rest, vocab, model)]).astype(np.float32)
    del sums, top
    shared = spark.sparkContext.broadcast((model, rest, table))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(words.value.ranks(b["word"].to_numpy()) < 0))
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array([x.tobytes() for x in numbers(b).astype(np.float32)], pa.binary())], ["word", "n", "own"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, (model, rest, table) = words.value, shared.value
        for b in slices(batches):
            index, bounds = unpacked(b["tokens"])
            n = np.diff(bounds)
            lists = np.maximum(-T.reduce_by_text(np.minimum, index, bounds), 0)  # length of each text's own list
            ahead = np.concatenate([[0], np.cumsum(lists)])
            index = np.where(index >= 0, index, len(table) + np.repeat(ahead[:-1], n) - 1 - index)
            sums, counts = np.zeros((ahead[-1], states), dtype=np.float32), np.zeros(ahead[-1], dtype=np.int64)
            found = b["found"].flatten()
            at = np.repeat(ahead[:-1], b["found"].value_lengths().fill_null(0).to_numpy()) + found.field("at").to_numpy()
            sums[at] = np.frombuffer(b"".join(found.field("own").to_pylist()), np.float32).reshape(-1, states)
            counts[at] = found.field("n").to_numpy()
            seen = np.concatenate([vocab.counts, counts])[index]
            there = np.zeros(len(table) + len(sums), dtype=bool)
            there[index] = True
            used, index = np.flatnonzero(there), (np.cumsum(there) - 1)[index]  # only the emissions that this batch needs
            split = np.searchsorted(used, len(table))
            emits = np.concatenate([table[used[:split]], emissions(sums, rest, vocab, model)[used[split:] - len(table)]])
            logs = Model(model.start, model.later, model.moves, emits).logs(index, bounds)
            base = T.reduce_by_text(np.add, np.log10(seen + 1.0), bounds) - n * np.log10(vocab.base_denominator)
            known = T.reduce_by_text(np.add, (seen > 0).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(known), pa.array(base), pa.array(logs / np.log(10))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rare = lexicon.mapInArrow(packed, "word bigint, n bigint, own binary")
    met = texts.select("row", F.posexplode("rare").alias("at", "word")).join(rare.hint("merge"), "word")
    lists = met.groupBy("row").agg(F.collect_list(F.struct("at", "n", "own")).alias("found"))
    out = texts.select("row", "doc_id", "tokens").join(lists.hint("merge"), "row", "left").drop("row").mapInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    held = F.coalesce(crc_rest("doc_id", modulus) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
