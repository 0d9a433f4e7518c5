"""Runs: manifests of inputs and options, derivations of runs and their rules, reuse of what an equal manifest has made, metric rows and their report."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle


def input_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of input files, read where they are; files of more than 2 GB are hashed by their lines."""
    files = spark.read.format("binaryFile").load(list(paths))
    small = files.filter(F.col("length") < (1 << 31) - 1).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in files.filter(F.col("length") >= (1 << 31) - 1).select("path").collect()]  # a row for each input file
    for path in large:
        lines = spark.read.text(path).select(F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
        small = small.unionByName(lines.select(F.lit(path).alias("path"), F.lit(None).cast("bigint").alias("length"), F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n").cast("string")), 256).alias("sha256")))
    return small


def manifest(spark: SparkSession, options: dict, *paths: str) -> dict:
    """Options, inputs by hash, and one key for all of it."""
    inputs = {r["path"].rpartition("/")[2]: r["sha256"] for r in input_hashes(spark, *paths).orderBy("path").collect()}  # a row for each input file
    body = {"options": options, "inputs": inputs}
    return body | {"key": body_key(body)}


def changed(old: dict, new: dict) -> list[str]:
    """What differs between two manifests: names of options and inputs."""
    out = []
    for part in ("options", "inputs"):
        a, b = old.get(part, {}), new.get(part, {})
        out += [f"{part}.{k}" for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
    return out


@dataclass(frozen=True)
class Rule:
    """What a run that is derived from another may change."""

    may: frozenset[str]
    rises: frozenset[str] = frozenset()  # numbers that must be greater than before
    must: frozenset[str] = frozenset()  # options that must be changed
    reason: bool = True
    inputs: bool = False  # whether other inputs are allowed
    reuses: frozenset[str] = frozenset()  # what of the earlier run stays valid


#: Kinds of derivation: other settings of the machine; more rounds under the same rule for stopping; another evaluation of the same model;
#: corrected code, whose results are no confirmation.
RULES = {
    "execution": Rule(frozenset({"name", "threads"}), reuses=frozenset({"features", "model"})),
    "continuation": Rule(frozenset({"iterations"}), rises=frozenset({"iterations"}), must=frozenset({"iterations"}), reuses=frozenset({"features", "model"})),
    "evaluation": Rule(frozenset({"name"}), must=frozenset({"name"}), reuses=frozenset({"features", "model"})),
    "correction": Rule(frozenset({"name", "inspected", "timing"}), must=frozenset({"inspected", "timing"}), reuses=frozenset({"features"})),
}


def body_key(manifest: dict) -> str:
    """The hash of all that a manifest holds but its own key."""
    return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "key"}, sort_keys=True).encode()).hexdigest()


def refused(old: dict, new: dict, kind: str, reason: str = "", rules: dict[str, Rule] = RULES) -> list[str]:
    """Why a run may not be derived from another; an empty list permits it."""
    rule = rules.get(kind)
    if rule is None:
        return ["kind"]
    before, after = old.get("options", {}), new.get("options", {})
    differ = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    out = [f"changes {k}" for k in sorted(differ - rule.may)] + [f"keeps {k}" for k in sorted(rule.must - differ)]
    out += [f"does not raise {k}" for k in sorted(rule.rises & differ) if not (before.get(k) is not None and after.get(k) is not None and after[k] > before[k])]
    out += ["inputs"] if not rule.inputs and old.get("inputs", {}) != new.get("inputs", {}) else []
    out += ["reason"] if rule.reason and not reason.strip() else []
    return out + [part for part, m in (("earlier key", old), ("own key", new)) if m.get("key") != body_key(m)]


def derived(old: dict, new: dict, kind: str, reason: str = "", rules: dict[str, Rule] = RULES) -> dict:
    """new as a manifest that names what it is derived from, how and why, under a key of its own; an error where the rules refuse it."""
    if faults := refused(old, new, kind, reason, rules):
        raise ValueError(f"no {kind} of {old.get('key')}: {', '.join(faults)}")
    body = {k: v for k, v in new.items() if k != "key"} | {"derivation": {"from": old["key"], "kind": kind, "reason": reason.strip()}}
    return body | {"key": body_key(body)}


def lineage_faults(runs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(key, fault): what is wrong with the derivations of runs (key, source, kind, reason, options as map of strings).

    A run without a source is an origin. Options are compared with the source's in one join; "no origin" is said of runs whose sources lead to
    none, which are found by doubling the pointers to sources, so a chain of n runs takes log2(n) rounds.
    """
    own = runs.select("key", "source", "kind", "reason", "options")
    before = runs.select(F.col("key").alias("source"), F.col("options").alias("before"), F.lit(True).alias("there"))
    pairs = own.filter("source is not null").join(before, "source", "left")
    names = F.array_distinct(F.concat(F.map_keys("options"), F.map_keys("before")))
    differ = F.filter(names, lambda k: ~F.try_element_at("options", k).eqNullSafe(F.try_element_at("before", k)))
    faults = F.when(F.col("there").isNull(), F.array(F.lit("no source")))
    listed = lambda found: F.array(*map(F.lit, sorted(found))) if found else F.array().cast("array<string>")
    say = lambda verb, found: F.transform(F.array_sort(found), lambda k: F.concat(F.lit(f"{verb} "), k))
    for kind, rule in rules.items():
        number = lambda side, k: F.try_element_at(side, k).try_cast("double")
        lower = F.filter(F.array_intersect("differ", listed(rule.rises)), lambda k: ~F.coalesce(number("options", k) > number("before", k), F.lit(False)))  # noqa: B023
        found = F.concat(say("changes", F.array_except("differ", listed(rule.may))), say("keeps", F.array_except(listed(rule.must), "differ")), say("does not raise", lower))
        if rule.reason:
            found = F.concat(found, F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", F.array(F.lit("reason"))).otherwise(F.array().cast("array<string>")))
        faults = faults.when(F.col("kind") == kind, found)
    faults = faults.otherwise(F.array(F.lit("kind")))
    said = pairs.withColumn("differ", differ).withColumn("fault", F.explode(faults)).select("key", "fault")

    keys = runs.select("key").distinct()
    ends = settle(own.select("key", F.col("source").alias("far")).join(keys.withColumnRenamed("key", "far"), "far", "left_semi").select("key", "far"), "lineage")
    while True:  # pointers that lead on; what has reached an origin, or a source that is missing, falls out
        on = settle(ends.join(ends.select(F.col("key").alias("far"), F.col("far").alias("next")).hint("merge"), "far").select("key", F.col("next").alias("far")), "lineage")
        left = on.count()
        if not left or left == ends.count():
            break
        ends = on
    return said.unionByName(on.select("key", F.lit("no origin").alias("fault")).distinct())


def reused(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table that a run with this key has left in folder, or make()'s, left there for the next one."""
    path = f"{folder.rstrip('/')}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def metric_rows(df: DataFrame, **labels: object) -> DataFrame:
    """(labels, metric, value): a table of one row as a row for each of its columns."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in sorted(df.columns)))).alias("c")
    return df.select(*(F.lit(v).alias(k) for k, v in labels.items()), cells).select(*labels, "c.metric", "c.value")


def report(rows: DataFrame, *by: str) -> DataFrame:
    """(by, metric, median, min, max, n) of metric rows over the seeds."""
    return rows.groupBy(*by, "metric").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def annotation_agreement(prints: DataFrame) -> DataFrame:
    """(left, right, topic, jaccard): agreement of two runs' annotations of a topic, (run, topic, print) as set positions; two empty ones agree."""
    from .annotation import jaccard

    a = prints.select(F.col("run").alias("left"), "topic", F.col("print").alias("a"))
    b = prints.select(F.col("run").alias("right"), "topic", F.col("print").alias("b"))
    return a.join(b, "topic").filter("left < right").select("left", "right", "topic", jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def write_report(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV and as JSON lines, each in one file, in order."""
    ordered = rows.orderBy(*rows.columns).coalesce(1)
    ordered.write.csv(f"{path}/csv", header=True)
    ordered.write.json(f"{path}/jsonl")


def ranked_table(rows: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """rows with their place by a column, as a table is sorted; ties by the other columns."""
    rest = [c for c in rows.columns if c != column]
    order = [F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last(), *rest]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each motif
