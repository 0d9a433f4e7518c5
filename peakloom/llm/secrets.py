"""Secret scans: pattern spans, and grammars inferred from labelled credentials.

Characters of credentials are symbols of a few classes. For each label of the training credentials the common prefix is
literal; of the rest a prefix tree of class symbols is built, and its statistically compatible states are merged (red-blue
order, Hoeffding bound on the frequencies of ends and successors). A state that lies before the label's least length merges with states of its own
depth only, as each of them is as far from the first end; from there on states merge whatever their depth. That leaves a probabilistic automaton
which counts up to the least length and then loops, with frequencies of classes and ends of its own in each state, so no shorter
credential is made, and lengths between and beyond the labelled ones are.

Candidates start at each occurrence of a label's literal prefix, and, for labels without a prefix, at each of the label's characters that no letter
or digit stands before, also inside a stretch. They end where no letter or digit follows, up to REACH times the greatest labelled
length. A candidate's score is the log-likelihood of its best end, under the automaton, against Markov chains of classes, each step taken from the
likelier one: that of all the given texts, mixed with a small even share, and that of labelled strings which are no credentials (paths, names in
mixed case). From `threshold` nats on it is a `grammar` span. Without a prefix, one that stands in a stretch whose rest is itself DATA times
as far from ordinary text, as in encoded files, is none. All candidates of a batch of texts are followed side by side, a character a step, so time
is in proportion to the texts, whatever they hold.

Defined cases: null and empty texts have no spans; positions are code points; repeated rows give repeated results; of
overlapping candidates the best score wins, then the first start, then the first label in order of name; a
candidate that overlaps a base span adds no span; an empty table gives an empty result; a text of any length is one Python
string and a few arrays of its bytes; a column called `found` is replaced, all others are carried.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import documents

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more: runs are maximal
BASE62 = string.ascii_letters + string.digits
# Publicly documented shapes of credentials, as prefix, least and greatest length and alphabet of each part.
SHAPES = {
    "chat-token": [("xoxb-", 10, 13, string.digits), ("-", 10, 13, string.digits), ("-", 24, 32, BASE62)],
    "cloud-access-key": [("AKIA", 12, 28, string.ascii_uppercase + "234567")],
    "cloud-secret-key": [("", 36, 48, BASE62 + "+/")],
    "code-host-pat": [("glpat-", 20, 40, BASE62 + "-_")],
    "code-host-token": [("ghp_", 30, 60, BASE62)],
    "hex-key": [("", 24, 72, "0123456789abcdef")],
    "map-api-key": [("AIza", 30, 40, BASE62 + "-_")],
    "package-token": [("npm_", 30, 44, BASE62)],
    "payment-key": [("sk_live_", 20, 99, BASE62)],
    "signed-token": [("eyJ", 20, 60, BASE62), (".eyJ", 30, 120, BASE62 + "-_"), (".", 27, 86, BASE62 + "-_")],
}
# The classes of credential characters; a class's probability is spread evenly over its characters.
CLASSES = ("abcdef", string.ascii_lowercase[6:], string.ascii_uppercase, string.digits, ".", "-", "/", "_", "=", "+")
KIND = np.zeros(256, dtype=np.int64)  # 0: no credential character
for _number, _members in enumerate(CLASSES, 1):
    KIND[np.frombuffer(_members.encode(), np.uint8)] = _number
N_KINDS = len(CLASSES) + 1
SPREAD = [0.0, *(math.log(len(x)) for x in CLASSES)]
# Ordinary text, from which the background starts; it counts as PRIOR_PAIRS pairs of characters, so that few texts don't rule it.
ORDINARY = "The quick brown foxes, some 12 of them (see Table 3-B), ran past https://www.example.org/path/index.html in 2024 and said: it is well-known that file_name.txt isn't here. "
PRIOR_PAIRS = 100_000
# Strings that are no credentials, by kind: their chain of classes stands beside the background.
OTHERS = {
    "mixed-case": "TheQuickBrownFoxJumpsOverTheLazyDog someVariableNameInCamelCase HttpServerConnectionFactory getElementsByTagName XMLHttpRequest QWidgetItemModel parseJSONResponse IOException",
    "path": "com/wiki/MainPage src/main/java/org/example/core/HttpServer.java images/2024/05/photo-final_v2.jpg usr/local/lib/python3.13/site-packages/numpy/linalg assets/img/Header-Logo_Large.png api/v1/users/4821/orders/2024-05-17/items",
    "name": "MAX_RETRY_COUNT USER_AGENT_STRING snake_case_identifier well-known-host.example.org v1.2.3-beta.4 IMG_20240501_123456.JPG ISO-8859-1 2024-05-17T12.30.45",
}
NEVER = -math.inf
CUT = 7.0  # what it costs, in nats, to end a credential before a character that its label has too
RARE = 0.05  # the share of the background that is spread evenly over the classes: no single step tells more than some 5 nats
REACH = 1.5
DATA = 3.0
WORDLY = np.zeros(N_KINDS, dtype=bool)  # letters and digits
WORDLY[[1, 2, 3, 4]] = True


def labelled_credentials(per_label: int = 600, seed: int = 7) -> list[tuple[str, str]]:
    """The default training set: credentials drawn from the public shapes, of every length between their bounds."""
    rng = random.Random(seed)
    draw = lambda parts: "".join(prefix + "".join(rng.choices(alphabet, k=rng.randint(low, high))) for prefix, low, high, alphabet in parts)
    return [(label, draw(parts)) for label, parts in SHAPES.items() for _ in range(per_label)]


def kinds(s: str) -> list[int]:
    return KIND[np.frombuffer(s.encode("ascii", "replace"), np.uint8)].tolist()


class Automaton:
    """A literal prefix, then a deterministic probabilistic automaton over classes, by state merging."""

    def __init__(self, strings: list[str], alpha: float = 0.05) -> None:
        first, last = min(strings), max(strings)
        self.prefix = first[: next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))]
        self.to: list[dict[int, int]] = [{}]
        self.through: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        self.depth: list[int] = [0]
        sizes = [len(s) - len(self.prefix) for s in strings]
        self.least, self.greatest = min(sizes), max(sizes)
        for s in strings:
            self._insert(kinds(s[len(self.prefix) :]))
        self.tree_states = len(self.to)
        self.alphabet = {k for node in self.through for k in node}
        red = self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self.states = len(red)
        # steps[state][class]: (log-probability, next state) or None; stops[state]: log-probability of the end
        number = {node: at for at, node in enumerate(red)}
        self.steps: list[list[tuple[float, int] | None]] = []
        self.stops: list[float] = []
        for node in red:
            total = max(self._count(node), 1)
            self.steps.append([(math.log(self.through[node][k] / total), number[self.to[node][k]]) if k in self.to[node] else None for k in range(N_KINDS)])
            self.stops.append(math.log(self.ends[node] / total) if self.ends[node] else NEVER)

    def _insert(self, symbols: list[int]) -> None:
        node = 0
        for k in symbols:
            if k not in self.to[node]:
                self.to[node][k] = len(self.to)
                self.to.append({})
                self.through.append({})
                self.ends.append(0)
                self.depth.append(self.depth[node] + 1)
            self.through[node][k] = self.through[node].get(k, 0) + 1
            node = self.to[node][k]
        self.ends[node] += 1

    def _count(self, node: int) -> int:
        return self.ends[node] + sum(self.through[node].values())

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self._count(a), self._count(b)
            margin = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if margin >= 1 and min(n, m) == 1:
                continue  # one string tells nothing, nor does what follows it
            if abs(self.ends[a] / n - self.ends[b] / m) > margin:
                return False
            for k in self.through[a].keys() | self.through[b].keys():
                if abs(self.through[a].get(k, 0) / n - self.through[b].get(k, 0) / m) > margin:
                    return False
                if k in self.to[a] and k in self.to[b]:
                    pairs.append((self.to[a][k], self.to[b][k]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        pairs = [(red, blue)]
        while pairs:
            a, b = pairs.pop()
            self.ends[a] += self.ends[b]
            for k, n in self.through[b].items():
                self.through[a][k] = self.through[a].get(k, 0) + n
                if k in self.to[a]:
                    pairs.append((self.to[a][k], self.to[b][k]))
                else:
                    self.to[a][k] = self.to[b][k]

    def _merge(self, bound: float) -> list[int]:
        """The states that are left, the first one first; the most frequented state beside them is merged or kept next."""
        red = [0]
        while blue := sorted({(-self._count(self.to[r][k]), at, k) for at, r in enumerate(red) for k in self.to[r] if self.to[r][k] not in red}):
            _, at, k = blue[0]
            node = self.to[red[at]][k]
            depth = self.depth[node]
            home = next((r for r in red if (self.depth[r] == depth if depth < self.least else self.depth[r] >= self.least) and self._compatible(r, node, bound)), None)
            if home is None:
                red.append(node)
            else:
                self.to[red[at]][k] = home
                self._fold(home, node)
        return red

    def log_likelihood(self, s: str) -> float:
        """Log-probability of the classes of s and its end; minus infinity where the automaton cannot make s."""
        if not s.startswith(self.prefix):
            return NEVER
        state, total = 0, 0.0
        for k in kinds(s[len(self.prefix) :]):
            if self.steps[state][k] is None:
                return NEVER
            total, state = total + self.steps[state][k][0], self.steps[state][k][1]
        return total + self.stops[state]


def infer(credentials: list[tuple[str, str]]) -> dict[str, Automaton]:
    return {label: Automaton([s for name, s in credentials if name == label]) for label in sorted({label for label, _ in credentials})}


def ordinary_counts() -> np.ndarray:
    seen = KIND[np.frombuffer(ORDINARY.encode(), np.uint8)]
    pairs = np.bincount(seen * N_KINDS + np.roll(seen, -1), minlength=N_KINDS * N_KINDS).reshape(N_KINDS, N_KINDS)
    return 1 + pairs * (PRIOR_PAIRS / pairs.sum())


def other_counts() -> np.ndarray:
    """Pairs inside the strings of OTHERS, each kind with the same weight; a string's ends are not told, so class 0 has an even share."""
    out = np.full((N_KINDS, N_KINDS), 0.01)
    for strings in OTHERS.values():
        pairs = np.zeros((N_KINDS, N_KINDS))
        for s in strings.split(" "):
            seen = KIND[np.frombuffer(s.encode(), np.uint8)]
            np.add.at(pairs, (seen[:-1], seen[1:]), 1)
        out += pairs / pairs.sum() * 100
    return out


def spread_rare(counts: np.ndarray) -> np.ndarray:
    return (1 - RARE) * counts / counts.sum(axis=1, keepdims=True) + RARE / N_KINDS


def background(docs: DataFrame, text: str = "text") -> list[list[float]]:
    """Log-probabilities of each class after each class (0: none) in all texts, beside ORDINARY, add-one smoothed, or in OTHERS, where likelier.

    One small row for each pair comes to the driver.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_KINDS * N_KINDS, dtype=np.int64)
        for b in batches:
            data, offsets = T.strings(b[text])
            for at in range(0, len(data), T.CHUNK_BYTES):
                now = KIND[data[at : at + T.CHUNK_BYTES + 1]]
                total += np.bincount(now[:-1] * N_KINDS + now[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) // N_KINDS), pa.array(np.arange(len(total)) % N_KINDS), pa.array(total)], ["prior", "kind", "n"])

    found = docs.select(text).mapInArrow(rows, "prior bigint, kind bigint, n bigint").groupBy("prior", "kind").agg(F.sum("n").alias("n")).toArrow()
    counts = ordinary_counts()
    counts[found["prior"].to_numpy(), found["kind"].to_numpy()] += found["n"].to_numpy()
    return np.log(np.maximum(spread_rare(counts), spread_rare(other_counts()))).tolist()


class Walker:
    """One label's automaton as tables, followed from many starts at a time."""

    def __init__(self, label: str, a: Automaton, ground: np.ndarray) -> None:
        self.label, self.prefix, self.ground = label, a.prefix.encode(), ground
        self.limit, self.least = math.ceil(REACH * a.greatest), a.least
        self.next = np.array([[x[1] if x else 0 for x in steps] for steps in a.steps])
        self.gain = np.array([[x[0] if x else NEVER for x in steps] for steps in a.steps])
        self.stop = np.array(a.stops)
        self.own = np.zeros(N_KINDS, dtype=bool)
        self.own[list(a.alphabet)] = True
        used = np.zeros(N_KINDS)
        for steps in a.through:
            for k, n in steps.items():
                used[k] += n
        self.usual = np.log(np.maximum(used / max(used.sum(), 1), 1e-300))  # of classes, wherever they stand

    def follow(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, start, end) of the best end from each start that has one."""
        best, end = np.full(len(starts), NEVER), starts.copy()
        prior, total = symbols[starts - 1], np.zeros(len(starts))
        for k in KIND[np.frombuffer(self.prefix, np.uint8)].tolist():
            total += SPREAD[k] - self.ground[prior, k]
            prior = np.full(len(starts), k)
        which, at, state = np.arange(len(starts)), starts + len(self.prefix), np.zeros(len(starts), np.int64)
        for _ in range(self.limit + 1):
            if not len(which):
                break
            after = symbols[at]
            score = np.where(WORDLY[after], NEVER, total + self.stop[state] - CUT * self.own[after])
            better = score > best[which]
            best[which[better]], end[which[better]] = score[better], at[better]
            gain = self.gain[state, after]
            on = gain > NEVER
            which, at, total = which[on], at[on] + 1, (total[on] + gain[on] - self.ground[prior[on], after[on]])
            state, prior = self.next[state[on], after[on]], after[on]
        return best, starts, end

    def starts(self, symbols: np.ndarray, raw: bytes) -> np.ndarray:
        if self.prefix:
            out, at = [], raw.find(self.prefix)
            while at >= 0:
                out.append(at)
                at = raw.find(self.prefix, at + 1)
            return np.array(out, dtype=np.int64)
        first, last = self.stretches(symbols)
        long = last - first >= max(self.least, 1)
        sizes = (last - first)[long]
        at = np.repeat(first[long] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        room = np.repeat(last[long], sizes) - at
        return at[(room >= max(self.least, 1)) & ~WORDLY[symbols[at - 1]]]

    def stretches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(self.own[symbols].view(np.int8)))  # symbols start and end with 0
        return edge[::2] + 1, edge[1::2] + 1

    def rest(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far from ordinary text the rest of each span's stretch is, in nats."""
        gain = np.where(self.own[symbols[1:]], self.usual[symbols[1:]] - self.ground[symbols[:-1], symbols[1:]], 0.0)
        sums = np.concatenate([[0.0, 0.0], np.cumsum(gain)])  # sums[i]: of symbols before i
        first, last = self.stretches(symbols)
        at = np.searchsorted(first, start, side="right") - 1
        return sums[last[at]] - sums[first[at]] - (sums[end] - sums[start])


class Scanner:
    """All labels' automata against one background."""

    def __init__(self, automata: dict[str, Automaton], ground: list[list[float]], threshold: float) -> None:
        self.walkers, self.threshold = [Walker(label, a, np.array(ground)) for label, a in automata.items()], threshold

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, str, str, float]]]:
        """Grammar spans of each text, in code points, CHUNK_BYTES of text at a time."""
        out, first = [], 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + T.CHUNK_BYTES, side="right")) - 1)
            out += self._chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, str, str, float]]]:
        n = len(offsets) - 1
        padded = np.zeros(len(data) + n + 1, dtype=np.uint8)  # a byte that no credential has before, between and after the texts
        padded[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))] = data
        symbols, raw, begins = KIND[padded], padded.tobytes(), offsets[:-1] + np.arange(n) + 1
        found: list[list[tuple[float, int, str, int]]] = [[] for _ in range(n)]
        for walker in self.walkers:
            score, start, end = walker.follow(symbols, walker.starts(symbols, raw))
            good = score >= self.threshold
            if good.any() and not walker.prefix:
                good[good] = walker.rest(symbols, start[good], end[good]) < DATA * self.threshold
            for text, s, e, x in zip(np.searchsorted(begins, start[good], side="right") - 1, start[good].tolist(), end[good].tolist(), score[good].tolist(), strict=True):
                found[text].append((-x, s - int(begins[text]), walker.label, e - int(begins[text])))
        out = []
        for text, candidates in enumerate(found):
            spans = apart(candidates)
            own = data[offsets[text] : offsets[text + 1]]
            if spans and (own >= 0x80).any():
                points = np.cumsum((own & 0xC0) != 0x80)
                spans = [(int(points[s]) - 1, int(points[e - 1]), kind, label, x) for s, e, kind, label, x in spans]
            out.append(spans)
        return out


def apart(candidates: list[tuple[float, int, str, int]]) -> list[tuple[int, int, str, str, float]]:
    """Of candidates (-score, start, label, end) the best ones that overlap no better one, by start."""
    starts, kept = [], []
    for score, s, label, e in sorted(candidates):
        at = bisect.bisect_right(starts, s)
        if (not at or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
            starts.insert(at, s)
            kept.insert(at, (s, e, "grammar", label, -score))
    return kept


def beside(spans: list[tuple], base: list[tuple[int, int, str]]) -> list[tuple]:
    """The spans that overlap none of base."""
    joint: list[list[int]] = []
    for s, e, _ in sorted(base):
        if joint and s < joint[-1][1]:
            joint[-1][1] = max(joint[-1][1], e)
        else:
            joint.append([s, e])
    starts = [s for s, _ in joint]
    out = []
    for x in spans:
        at = bisect.bisect_right(starts, x[0])
        if (not at or joint[at - 1][1] <= x[0]) and (at == len(joint) or x[1] <= joint[at][0]):
            out.append(x)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("label", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, credentials: list[tuple[str, str]] | None = None, threshold: float = 16.0, text: str = "text") -> DataFrame:
    """docs' columns but text, with `found`: spans (start, end, kind, label, score) of each whole text."""
    automata = infer(labelled_credentials() if credentials is None else credentials)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(automata, background(docs, text), threshold))  # a few automata of bounded training strings
    kept = [c for c in docs.columns if c not in (text, "found")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "found array<struct<start:bigint,end:bigint,kind:string,label:string,score:double>>"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for b in batches:
            data, offsets = T.strings(b[text])
            out = []
            for t, grammar in zip(b[text].to_pylist(), scanner.batch(data, offsets), strict=True):
                base = base_spans(t or "")
                rows = [(*x, None, None) for x in base] + beside(grammar, base)
                out.append([dict(zip(("start", "end", "kind", "label", "score"), x, strict=True)) for x in sorted(rows, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(out, FOUND)], [*kept, "found"])

    return docs.select(*kept, text).mapInArrow(spans, schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, found) as counts, the hash of the base spans, and all spans as a string."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[(x["start"], x["end"], x["kind"]) for x in row] for row in b["found"].to_pylist()]
            count = [pa.array([sum(k == kind for *_, k in row) for row in spans], pa.int64()) for kind in KINDS[:3]]
            base = [hashlib.sha256(joined([x for x in row if x[2] != "grammar"]).encode()).hexdigest() for row in spans]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *count, pa.array(base, pa.string()), pa.array([joined(row) for row in spans], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.select("doc_id", "found").mapInArrow(rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(documents(spark, sf_dir).select("doc_id", "text")))
