"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its sample vectors at the median of their products with a random
direction, the difference of two of its own vectors. Every row is then indexed: it falls into one leaf of each tree. A query walks
all trees through one priority queue, ordered by the largest distance by which the path had to cross a split, and takes
the first leaves until these held a set share of the sample, counted over all trees. Candidates are the rows of these
leaves; they are reranked by the exact inner product in double precision.

Leaves that hold more than `most_rows` rows, as all do in a table much larger than the sample, are split further on all machines,
a halving a round, down to that number; a query follows to every part that is no farther across the splits than its walk has gone, and takes the
nearest of them first, up to a number of rows. That number is measured too, on `trial_queries` of the queries, against all rows.

The share is measured, not set: for `trial_queries` vectors of the sample, their `k` nearest in the sample are found exhaustively, and
the share is the least at which the walks have met `target_recall` of them. So clustered vectors visit few leaves, and
vectors without any structure, of which no tree can pass over many, visit about as many rows as there are.

For inner products the vectors are first extended by sqrt(M**2 - |v|**2), where M is the largest norm, so that the nearest
by angle is the one with the largest product; queries are extended by 0.

Rows and queries meet on (tree, leaf); crowded leaves are cut into blocks by hash on both sides and every pair of blocks is
a group, so a vector that a third of all rows hold is many groups, and so is a vec_id with many vectors. Equal rows are
made one before that. A group returns each query's best `k` distinct vec_ids, which is all that the final ranking over groups can use.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components
take no part on either side, as do rows with a null vec_id; vectors have products with those of their own length only, and each length
has a forest; rows of the query's own vec_id are no candidates; a vec_id on several rows is one candidate with its best
product, and as a query one with all its vectors; ties go to the smaller vec_id; other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import least_hashed, settle, tune

BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
WIDER = 2.0


@dataclass
class Tree:
    """Nodes by number: direction and threshold of inner ones, children (negative: ~leaf), share of the sample in leaves."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    share: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64) if len(self.thresholds) else np.full(len(x), -1)
        while len(at := np.flatnonzero(node >= 0)):
            n = node[at]
            right = np.einsum("ij,ij->i", x[at], self.directions[n]) > self.thresholds[n]
            node[at] = self.children[n, right.astype(int)]
        return ~node


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    directions, thresholds, children, share = [], [], [], []
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop(0)
        split = None
        for _ in range(4 if len(rows) > leaf_rows else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            direction = a - b
            at = sample[rows] @ direction
            threshold = float(np.median(at))
            right = at > threshold
            if direction.any() and 0.1 * len(rows) <= right.sum() <= 0.9 * len(rows):
                split = direction / np.linalg.norm(direction), threshold / np.linalg.norm(direction), right
                break
        if split is None:
            name = ~len(share)
            share.append(len(rows) / max(len(sample), 1))
        else:
            name = len(thresholds)
            directions.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            todo += [(rows[~split[2]], name, 0), (rows[split[2]], name, 1)]
        if parent >= 0:
            children[parent][side] = name
    width = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(share))


@dataclass
class Forest:
    trees: list[Tree]
    norm: float
    width: int

    def extend(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def search(self, x: np.ndarray, search_share: float) -> list[tuple[int, int, float]]:
        """(tree, leaf, distance) of what one extended query visits, in order: the distance is the largest by which the path crossed a split."""
        products = [t.directions @ x - t.thresholds for t in self.trees]
        queue = [(0.0, k, 0 if len(t.thresholds) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        out, seen = [], 0.0
        while queue and seen < search_share * len(self.trees):
            far, k, node = heapq.heappop(queue)
            while node >= 0:
                p = products[k][node]
                near = int(p > 0)
                heapq.heappush(queue, (max(far, abs(p)), k, int(self.trees[k].children[node, 1 - near])))
                node = int(self.trees[k].children[node, near])
            out.append((k, ~node, far))
            seen += self.trees[k].share[~node]
        return out

    def share_for(self, x: np.ndarray, k: int, target: float, trials: int) -> float:
        """The least search share at which the k nearest of `trials` rows of x, among x, are found with this recall."""
        chosen = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
        leaves = [t.leaves(self.extend(x, False)) for t in self.trees]
        met = []
        for i in chosen:
            near = x @ x[i]
            near[i] = -np.inf
            best = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else np.zeros(0, int)
            visits = self.search(self.extend(x[i : i + 1], True)[0], np.inf)
            before = np.concatenate([[0], np.cumsum([self.trees[tree].share[leaf] for tree, leaf, _ in visits])[:-1]]) / len(self.trees)
            first = [np.full(len(t.share), np.inf) for t in self.trees]
            for (tree, leaf, _), at in zip(visits, before, strict=True):
                first[tree][leaf] = at
            met.append(np.min([f[own[best]] for f, own in zip(first, leaves, strict=True)], axis=0))
        met = np.sort(np.concatenate(met)) if met else np.zeros(0)
        return float(met[max(0, int(np.ceil(target * len(met))) - 1)]) + 1e-9 if len(met) else 1.0


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; floats stay floats until they are multiplied, to halve what is shuffled."""
    v = F.col(vector) if df.schema[vector].dataType == ArrayType(FloatType()) else F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, trees: int, leaf_rows: int, sample_rows: int, seed: int, k: int, target_recall: float, trials: int) -> tuple[Forest, float]:
    """A forest from at most sample_rows vectors, by hash of vec_id, and its search share; M is taken over all rows."""
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
    sample = matrix(least_hashed(rows, F.xxhash64("vec_id"), sample_rows, "vec_id").select("v").toArrow()["v"].combine_chunks())
    sample = np.unique(sample, axis=0)  # copies would fill leaves that no plane can split
    rng = np.random.default_rng(seed)
    forest = Forest([], norm, sample.shape[1])
    if len(sample):
        extended = forest.extend(sample, False)
        forest.trees = [grow(extended, leaf_rows, rng) for _ in range(trees)]
    return forest, forest.share_for(sample, k, target_recall, trials) if len(sample) else 0.0


def grown(held: DataFrame, wanted: DataFrame, norm: float, most_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """held (vec_id, v, leaf) and wanted (vec_id, v, far, leaf, cross) after every leaf of more than most_rows rows is split until none is, but for
    equal vectors, and whether any was.

    A round halves all such leaves where their rows lie: the direction is the difference of two of a leaf's vectors, by hash, the
    threshold the median of the products. A query goes on to the side it lies on, and across where that is no farther than its walk through the
    trees has gone.
    """

    def extended(x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def products(df: DataFrame, splits: DataFrame, query: bool) -> DataFrame:
        """df joined with its leaves' splits, with `p`, the products with the unit directions."""
        joined = df.join(splits.hint("merge"), "leaf")
        names = [c for c in joined.columns if c not in ("a", "b")]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    direction = extended(matrix(b["a"]), False) - extended(matrix(b["b"]), False)
                    length = np.linalg.norm(direction, axis=1)
                    p = np.einsum("ij,ij->i", extended(matrix(b["v"]), query), direction) / np.where(length > 0, length, 1)
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(p)], [*names, "p"])

        return joined.mapInArrow(rows, ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names) + ", p double")

    place, split = F.xxhash64("vec_id", "v"), False
    while True:
        crowded = held.groupBy("leaf").agg(F.count("*").alias("n"), F.min_by("v", place).alias("a"), F.max_by("v", place).alias("b"))
        crowded = settle(crowded.filter((F.col("n") > most_rows) & (F.col("a") != F.col("b"))).drop("n"), "forest-crowded")
        if crowded.isEmpty():
            return held, wanted, split
        cuts = products(held, crowded, False).groupBy("leaf").agg(F.percentile_approx("p", F.lit(0.5), F.lit(1000)).alias("t"), F.min("p").alias("low"), F.max("p").alias("top"))
        middle = (F.col("low") + F.col("top")) / 2  # where most rows share the largest product
        cuts = cuts.filter("low < top").select("leaf", F.when(F.col("t") < F.col("top"), F.col("t")).when(middle < F.col("top"), middle).otherwise(F.col("low")).alias("t"))
        splits = settle(crowded.join(cuts.hint("merge"), "leaf"), "forest-splits")
        if splits.isEmpty():
            return held, wanted, split
        child = lambda side: F.xxhash64("leaf", side)
        side = F.col("p") > F.col("t")
        away = F.abs(F.col("p") - F.col("t"))
        down = products(held, splits, False).select("vec_id", "v", child(side).alias("leaf"))
        here, across = F.struct(child(side).alias("leaf"), F.col("cross")), F.struct(child(~side).alias("leaf"), F.greatest("cross", away).alias("cross"))
        asked = products(wanted, splits, True).select("vec_id", "v", "far", F.inline(F.when(away <= F.col("far"), F.array(here, across)).otherwise(F.array(here))))
        rest = splits.select("leaf").hint("merge")
        held = settle(held.join(rest, "leaf", "left_anti").select("vec_id", "v", "leaf").unionByName(down), "forest-rows")
        wanted = settle(wanted.join(rest, "leaf", "left_anti").select("vec_id", "v", "far", "leaf", "cross").unionByName(asked), "forest-queries")
        split = True


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, vec_id): the k nearest of all rows for each of a few vectors (q, own, x), by one pass over the rows."""
    few = asked.toArrow()  # trial queries: a bounded number
    q, own, x = few["q"].to_numpy(), few["own"].to_numpy(), matrix(few["x"].combine_chunks())
    shared = rows.sparkSession.sparkContext.broadcast((q, own, x))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, x = shared.value
        for b in batches:
            if len(b) and len(q):
                ids = b["vec_id"].to_numpy()
                score = x @ matrix(b["v"]).T
                score[own[:, None] == ids[None, :]] = -np.inf
                n = min(k, len(ids))
                at = np.argpartition(-score, n - 1, axis=1)[:, :n]
                line = np.repeat(np.arange(len(q)), n)
                yield pa.RecordBatch.from_arrays([pa.array(q[line]), pa.array(ids[at.reshape(-1)]), pa.array(score[line, at.reshape(-1)])], ["q", "vec_id", "score"])

    each = rows.mapInArrow(found, "q bigint, vec_id bigint, score double").filter(F.col("score") > float("-inf")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("q", "vec_id")


def budgeted(rows: DataFrame, asked: DataFrame, held: DataFrame, wanted: DataFrame, k: int, target_recall: float, trials: int) -> DataFrame:
    """wanted's leaves, nearest across the splits first, until they hold a number of rows: the least at which `trials` of the queries have met this
    share of their k nearest of all rows. All leaves stay if that share is not met."""
    sizes = held.groupBy("leaf").agg(F.count("*").alias("n"))
    own = F.xxhash64("vec_id", "v")
    ahead = Window.partitionBy("q").orderBy("cross", "leaf").rowsBetween(Window.unboundedPreceding, -1)  # the leaves of one query
    walks = settle(wanted.withColumn("q", own).join(sizes.hint("merge"), "leaf").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "forest-walks")
    tried = settle(least_hashed(asked.select("vec_id", "v"), own, trials, "vec_id").select(own.alias("q"), F.col("vec_id").alias("own"), F.col("v").alias("x")), "forest-trials")
    true = settle(nearest(rows, tried, k), "forest-nearest")  # trials * k rows
    homes = held.join(F.broadcast(true), "vec_id").select("q", F.col("vec_id").alias("near"), "leaf").distinct()
    met = walks.join(F.broadcast(tried.select("q").distinct()), "q", "left_semi").join(homes, ["q", "leaf"]).groupBy("q", "near").agg(F.min("before").alias("before"))
    total, needed = true.count(), sorted(r["before"] for r in met.select("before").collect())
    wish = int(np.ceil(target_recall * total))
    if not total or len(needed) < wish:
        return walks.select("vec_id", "v", "far", "leaf", "cross")
    return walks.filter(F.col("before") <= needed[max(wish - 1, 0)]).select("vec_id", "v", "far", "leaf", "cross")


def best(table: pa.Table, k: int) -> pa.Table:
    """Each query's k best rows of a group: (query_id, vec_id, score)."""
    query = table["query"].to_numpy()
    ids, v = table["vec_id"].to_numpy(), matrix(table["v"].combine_chunks())
    q, qi, x, xi = v[query], ids[query], v[~query], ids[~query]
    by_id = np.argsort(xi, kind="stable")
    x, xi = x[by_id], xi[by_id]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(x):
        near = q @ x.T
        near[qi[:, None] == xi[None, :]] = -np.inf
        slack = 1e-9 * (np.abs(near[np.isfinite(near)]).max() if np.isfinite(near).any() else 0)
        top = np.maximum.reduceat(near, np.flatnonzero(np.diff(xi, prepend=xi[0] - 1)), axis=1)  # one column for each vec_id
        n = min(k, top.shape[1])
        least = np.partition(top, top.shape[1] - n, axis=1)[:, top.shape[1] - n]
        for row in range(len(q)):
            at = np.flatnonzero((near[row] >= least[row] - slack) & (near[row] > -np.inf))
            exact = (x[at] * q[row]).sum(axis=1)  # summed alike for equal vectors, unlike a product of blocks
            order = np.lexsort((xi[at], -exact))
            found, score = xi[at][order], exact[order]
            _, first = np.unique(found, return_index=True)
            first = np.sort(first)[:k]
            out.append((np.full(len(first), qi[row]), found[first], score[first]))
    cat = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), cat, strict=True)))


def search(df: DataFrame, queries: DataFrame, k: int = 20, trees: int = 12, leaf_rows: int = 64, sample_rows: int = 20_000, target_recall: float = 0.95, trial_queries: int = 150, most_rows: int = BLOCK_ROWS, seed: int = 11, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of df found for each row of queries."""
    rows, asked = vectors(df, key, vector).distinct(), vectors(queries, key, vector).distinct()
    widths = [r["n"] for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one, or a few
    parts = [_search(rows.filter(F.size("v") == n), asked.filter(F.size("v") == n), k, trees, leaf_rows, sample_rows, target_recall, trial_queries, most_rows, seed) for n in widths]
    once = functools.reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, k: int, trees: int, leaf_rows: int, sample_rows: int, target_recall: float, trial_queries: int, most_rows: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score) of each group's best, for vectors of one length."""
    forest, search_share = fit(rows, trees, leaf_rows, sample_rows, seed, k, target_recall, trial_queries)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            if len(b) and forest.trees:
                x = forest.extend(matrix(b["v"]), False)
                leaves = np.stack([t.leaves(x) for t in forest.trees], axis=1)
                bounds = pa.array(np.arange(len(b) + 1) * len(forest.trees), pa.int32())
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.ListArray.from_arrays(bounds, pa.array((leaves + (np.arange(len(forest.trees)) << 32)).reshape(-1)))], ["vec_id", "v", "leaves"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            if len(b) and forest.trees:
                x = forest.extend(matrix(b["v"]), True)
                found = [forest.search(row, walk_share) for row in x]
                leaves = pa.array([[{"leaf": leaf + (tree << 32), "cross": far} for tree, leaf, far in visits] for visits in found], pa.list_(pa.struct([("leaf", pa.int64()), ("cross", pa.float64())])))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], leaves, pa.array([max((x[2] for x in visits), default=0.0) for visits in found])], ["vec_id", "v", "leaves", "far"])

    schema = f"vec_id bigint, v {rows.schema['v'].dataType.simpleString()}, leaves array<bigint>"
    held = settle(rows.mapInArrow(indexed, schema), "forest-rows").select("vec_id", "v", F.explode("leaves").alias("leaf"))
    # where leaves will be split, walks go farther, for the budget to choose from
    walk_share = search_share if held.groupBy("leaf").count().filter(F.col("count") > most_rows).isEmpty() else WIDER * search_share
    schema = schema.replace("array<bigint>", "array<struct<leaf:bigint,cross:double>>") + ", far double"
    wanted = settle(asked.mapInArrow(asking, schema), "forest-queries").select("vec_id", "v", "far", F.inline("leaves"))
    held, wanted, split = grown(held, wanted, forest.norm, most_rows)
    if split:
        wanted = budgeted(rows, asked, held, wanted, k, target_recall, trial_queries)
    blocks = lambda d, n, name: d.groupBy("leaf").agg(F.ceil(F.count("*") / n).alias(name))
    # leaves may be as many as rows / most_rows: joined in shuffles
    crowd = settle(blocks(held, BLOCK_ROWS, "row_blocks").join(blocks(wanted, BLOCK_QUERIES, "query_blocks").hint("merge"), "leaf"), "forest-leaves")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "v", "leaf"), F.col(n))
    left = held.join(crowd.hint("merge"), "leaf").select("leaf", mine("row_blocks").alias("row_block"), spread("query_blocks").alias("query_block"), F.lit(False).alias("query"), "vec_id", "v")
    right = wanted.join(crowd.hint("merge"), "leaf").select("leaf", spread("row_blocks").alias("row_block"), mine("query_blocks").alias("query_block"), F.lit(True).alias("query"), "vec_id", "v")
    return left.unionByName(right).groupBy("leaf", "row_block", "query_block").applyInArrow(lambda table: best(table, k), "query_id bigint, vec_id bigint, score double")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.filter(F.col("vec_id") % 20 == 0))
