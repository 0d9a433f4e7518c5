"""Evaluation: distances of mixtures, one-to-one matching of topics, group splits and leakage audits."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def mixture_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc, cosine, js) of two theta tables (doc, topic, p); js: Jensen-Shannon divergence in nats. A missing row is 0."""
    both = left.withColumnsRenamed({"p": "a"}).join(right.withColumnsRenamed({"p": "b"}), ["doc", "topic"], "full_outer").na.fill(0.0, ["a", "b"])
    mid = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / mid)).otherwise(F.lit(0.0))
    sums = both.groupBy("doc").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), (F.sum(part("a") + part("b")) / 2).alias("js"))
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(F.lit(0.0))
    return sums.select("doc", cosine.alias("cosine"), "js")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one matching of rows to columns (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = at
            to = int(np.argmin(np.where(done[1:], np.inf, least[1:]))) + 1
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def matched_topics(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """(topic, topic, cosine) of the one-to-one matching of two topic-word tables with the largest sum of cosines."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cosine = unit(left) @ unit(right).T
    pairs = assignment(-cosine) if len(left) <= len(right) else [(i, j) for j, i in assignment(-cosine.T)]
    return sorted((i, j, float(cosine[i, j])) for i, j in pairs)


def topic_agreement(left: np.ndarray, right: np.ndarray, top: int) -> dict[str, object]:
    """The matching with means and medians of its cosines and of the Jaccard similarity of top words, ties to the earlier word."""
    matched = matched_topics(left, right)
    words = lambda x: [set(row.tolist()) for row in np.argsort(-x, axis=1, kind="stable")[:, :top]]
    a, b = words(left), words(right)
    alike = [len(a[i] & b[j]) / len(a[i] | b[j]) if a[i] | b[j] else 1.0 for i, j, _ in matched]
    cosines = [c for *_, c in matched]
    return {
        "pairs": [(i, j) for i, j, _ in matched], "cosine_mean": float(np.mean(cosines)), "cosine_median": float(np.median(cosines)),
        "jaccard_mean": float(np.mean(alike)), "jaccard_median": float(np.median(alike)),
    }


def agreement_rows(tables: dict[tuple[str, int], np.ndarray], top: int) -> list[dict[str, object]]:
    """Agreements of topic tables by (method, seed): all pairs of seeds of a method, then all pairs of methods of a seed."""
    out = []
    for kind, same, other in (("cross_seed", 0, 1), ("between_methods", 1, 0)):
        keys = sorted(tables, key=lambda k: (k[same], k[other]))  # noqa: B023
        for x in range(len(keys)):
            for y in range(x + 1, len(keys)):
                if keys[x][same] == keys[y][same]:
                    found = topic_agreement(tables[keys[x]], tables[keys[y]], top)
                    out.append({"comparison": kind, "left": keys[x], "right": keys[y], **{k: v for k, v in found.items() if k != "pairs"}})
    return out


def distance_summary(distances: DataFrame) -> DataFrame:
    """One row of mixture_distances' result: mean, median and the worse twentieth of both."""
    at = lambda c, q: F.percentile(c, F.lit(q))
    return distances.agg(
        F.avg("cosine").alias("cosine_mean"), at("cosine", 0.5).alias("cosine_median"), at("cosine", 0.05).alias("cosine_p05"),
        F.avg("js").alias("js_mean"), at("js", 0.5).alias("js_median"), at("js", 0.95).alias("js_p95"),
    )


def group_split(sizes: dict[str, int], shares: dict[str, float], seed: int) -> dict[str, str]:
    """A split for each group, large groups first, ties by digest.

    A group goes where it overshoots the wanted number by the least share of it, then where the largest share is still
    missing, then by digest. One pass in order of size: groups are counted before they come here.
    """
    total = sum(sizes.values())
    want = {s: share * total for s, share in shares.items()}
    have = dict.fromkeys(shares, 0)
    digest = lambda text: hashlib.sha256(f"{seed}\0{text}".encode()).hexdigest()
    out = {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], digest(g))):
        over = {s: max(have[s] + sizes[g] - want[s], 0.0) / max(want[s], 1.0) for s in want}
        missing = {s: (want[s] - have[s]) / max(want[s], 1.0) for s in want}
        out[g] = min(want, key=lambda s: (over[s], -missing[s], digest(f"{g}\0{s}")))  # noqa: B023
        have[out[g]] += sizes[g]
    return out


class Slots:
    """Where the groups of one size go, in order, from what the splits have before them.

    A split's next group of that size has a key, its overshoot and then what is missing less; the greedy rule takes the least key of all splits.
    A split's keys only rise, so the rule takes all splits' slots in the order of their keys, and how many each has taken after any
    number of groups is found by bisection. Slots of equal keys go by digest, which the groups decide.
    """

    def __init__(self, shares: list[float], total: int, have: list[int], size: int, seed: int) -> None:
        self.want, self.have, self.size, self.seed = [share * total for share in shares], have, size, seed

    def key(self, split: int, taken: int) -> tuple[float, float]:
        want, have = self.want[split], self.have[split] + taken * self.size
        return max(have + self.size - want, 0.0) / max(want, 1.0), -((want - have) / max(want, 1.0))

    def below(self, key: tuple[float, float], most: int) -> list[int]:
        """How many slots of each split, at most `most`, have a lesser key."""
        return [bisect.bisect_left(range(most), key, key=lambda k, s=s: self.key(s, k)) for s in range(len(self.want))]

    def after(self, n: int) -> tuple[int, list[int]]:
        """The greatest number of groups, at most n, after which no slots of equal keys are open, and what each split has taken then."""
        best = [0] * len(self.want)
        for s in range(len(self.want)):
            low = bisect.bisect_right(range(n + 1), n, key=lambda k, s=s: sum(self.below(self.key(s, k), n + 1))) - 1
            if low >= 0:
                best = max(best, self.below(self.key(s, low), n + 1), key=sum)
        return sum(best), best

    def deal(self, taken: list[int], groups: list[str], names: list[str]) -> list[int]:
        """The splits of the groups that come next, one by one; `taken` goes on."""
        out = []
        for g in groups:
            keys = [self.key(s, k) for s, k in enumerate(taken)]
            tied = [s for s, k in enumerate(keys) if k == min(keys)]
            chosen = tied[0] if len(tied) == 1 else min(tied, key=lambda s: hashlib.sha256(f"{self.seed}\0{g}\0{names[s]}".encode()).hexdigest())  # noqa: B023
            out.append(chosen)
            taken[chosen] += 1
        return out


CHUNK = 10_000


def split_by_group(records: DataFrame, group: str, shares: dict[str, float], seed: int) -> DataFrame:
    """records with `split`, whole groups in one split, as group_split deals them; rows without a group go.

    Groups are ranked by size and digest without coming to the driver. It sees one row for each different size, of which
    there are at most the square root of twice the records, and the last few groups of each, and works out what the splits have when a size
    begins. Chunks of groups of one size are then dealt apart, each from the state that bisection finds for its first rank.
    """
    names, few = list(shares), max(len(shares) - 1, 1)
    kind = records.schema[group].dataType.simpleString()
    sizes = records.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    ranked = numbered(sizes.withColumn("d", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("g").cast("string")), 256)), F.desc("n"), "d", name="rank")
    runs = sorted((-r["n"], r["groups"], r["first"]) for r in ranked.groupBy("n").agg(F.count("*").alias("groups"), F.min("rank").alias("first")).collect())
    total = sum(-n * c for n, c, _ in runs)
    spark = records.sparkSession
    listed = F.broadcast(spark.createDataFrame([(-n, c, f) for n, c, f in runs], "n bigint, groups bigint, first bigint"))
    placed = ranked.join(listed, "n").withColumn("r", F.col("rank") - F.col("first"))
    last: dict[int, list[str]] = {}
    for r in sorted(placed.filter(F.col("r") >= F.col("groups") - few).select("n", "r", F.col("g").cast("string").alias("g")).collect()):
        last.setdefault(r["n"], []).append(r["g"])
    have, states = [0] * len(names), {}
    for n, count, _ in runs:
        states[-n] = list(have)
        slots = Slots(list(shares.values()), total, list(have), -n, seed)
        done, taken = (0, [0] * len(names)) if count <= few else slots.after(count)
        slots.deal(taken, last[-n][len(last[-n]) - (count - done) :] if count > done else [], names)
        have = [h + k * -n for h, k in zip(have, taken, strict=True)]
    shared = spark.sparkContext.broadcast(states)

    def dealt(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        n, chunk, ranks, groups = table["n"][0].as_py(), table["chunk"][0].as_py(), table["r"].to_pylist(), table["name"].to_pylist()
        slots = Slots(list(shares.values()), total, shared.value[n], n, seed)
        begin, taken = slots.after(chunk * CHUNK)
        at = ranks.index(begin)  # at most a few groups before the chunk
        split = slots.deal(taken, groups[at:], names)
        own = [k for k in range(at, len(ranks)) if ranks[k] >= chunk * CHUNK]
        return pa.table({"g": table["g"].take(pa.array(own)), "split": [names[split[k - at]] for k in own]})

    chunks = F.sequence(F.floor(F.col("r") / CHUNK), F.floor((F.col("r") + few) / CHUNK))  # the last few before a chunk are seen there too
    rows = placed.select("g", F.col("g").cast("string").alias("name"), "n", "r", F.explode(chunks).alias("chunk")).filter(F.col("chunk") * CHUNK < F.col("groups"))
    chosen = rows.groupBy("n", "chunk").applyInArrow(dealt, f"g {kind}, split string").withColumnRenamed("g", group)
    return records.join(chosen.hint("merge"), group)


def leakage(records: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The keys that more than one split holds, with how many do."""
    return records.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")
