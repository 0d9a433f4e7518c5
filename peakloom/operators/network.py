"""Motif networks as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_edges(beta: DataFrame, least: float = 0.05) -> DataFrame:
    """(motif, feature, weight, color): fragments in red, losses in blue; beta (motif, kind, mz, p)."""
    color = F.when(F.col("kind") == "frag", "red").otherwise("blue")
    return beta.filter(F.col("p") >= least).select("motif", F.concat_ws("_", "kind", F.col("mz").cast("string")).alias("feature"), F.col("p").alias("weight"), color.alias("color"))


def document_edges(theta: DataFrame, overlaps: DataFrame, least_p: float = 0.1, least_overlap: float = 0.3, top: int = 3) -> DataFrame:
    """(doc, topic, p, overlap): the `top` topics of each document above both limits."""
    kept = theta.join(overlaps, ["doc", "topic"]).filter((F.col("p") >= least_p) & (F.col("overlap") >= least_overlap))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("p"), "topic"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top)


def elements(motif_peaks: DataFrame, precursor: float | None = None, least: float = 0.05, margin: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, kind), edges (source, target, weight)) of motifs and their features (motif, kind, mz, p), each node once.

    With a precursor, a loss gets an edge of weight null to the fragment at precursor - loss, where a motif has both.
    """
    kept = motif_peaks.filter(F.col("p") >= least).withColumn("feature", F.concat_ws("_", "kind", F.col("mz").cast("string")))
    edges = kept.groupBy(F.col("motif").alias("source"), F.col("feature").alias("target")).agg(F.max("p").alias("weight"))
    nodes = kept.select(F.col("motif").alias("id"), F.lit("motif").alias("kind")).union(kept.select("feature", "kind")).distinct()
    if precursor is not None:
        at = F.floor(F.col("at") / margin)
        losses = kept.filter("kind = 'loss'").select("motif", F.col("feature").alias("source"), (F.lit(float(precursor)) - F.col("mz")).alias("at")).withColumn("bin", F.explode(F.sequence(at - 1, at + 1)))
        fragments = kept.filter("kind = 'frag'").select("motif", F.col("feature").alias("target"), F.col("mz").alias("at2"), F.floor(F.col("mz") / margin).alias("bin"))
        linked = losses.join(fragments, ["motif", "bin"]).filter(F.abs(F.col("at") - F.col("at2")) <= margin)
        edges = edges.unionByName(linked.select("source", "target", F.lit(None).cast("double").alias("weight")).distinct())
    return nodes, edges


def node_sizes(motifs: DataFrame, default: float = 1000.0) -> DataFrame:
    """(motif, size, size_interactive) of motifs (motif, score, molecules, features): score null counts as 0.7 where any has one, else all have the default.

    The interactive size adds the motif's share of the largest numbers of molecules and features.
    """
    whole = Window.partitionBy()  # a row for each motif
    any_score = F.max(F.col("score").isNotNull()).over(whole)
    score = F.coalesce("score", F.lit(0.7))
    cubed = lambda c: F.pow(c * 10, F.lit(3.0)) / 3
    share = lambda c: F.col(c) / F.max(c).over(whole)
    return motifs.select(
        "motif",
        F.when(any_score, F.pow(score * 100, F.lit(2.0)) / 2).otherwise(default).alias("size"),
        F.when(any_score, cubed(score) + cubed(share("molecules")) + cubed(share("features"))).otherwise(default).alias("size_interactive"),
    )


def set_pairs(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), one row with the number of different motifs on each side) of matches of two motif sets."""
    pairs = matches.select("a", "b").distinct()
    return pairs, pairs.agg(F.countDistinct("a").alias("n_a"), F.countDistinct("b").alias("n_b"))


def _attribute(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def graphml_lines(edges: DataFrame) -> DataFrame:
    """(place, value): a GraphML document of motif-feature edges (motif, feature, weight, color), line by line in order of place."""
    spark = edges.sparkSession
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<key id="color" for="edge" attr.name="color" attr.type="string"/>', '<graph edgedefault="undirected">']
    fixed = spark.createDataFrame([(0, str(k).zfill(3), line) for k, line in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")], "part int, name string, value string")
    names = edges.select(F.col("motif").cast("string").alias("name")).union(edges.select("feature")).distinct()
    nodes = names.select(F.lit(1).alias("part"), "name", F.concat(F.lit('<node id="'), _attribute(F.col("name")), F.lit('"/>')).alias("value"))
    cell = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), _attribute(F.col(c).cast("string")), F.lit("</data>"))
    line = F.concat(F.lit('<edge source="'), _attribute(F.col("motif").cast("string")), F.lit('" target="'), _attribute(F.col("feature")), F.lit('">'), cell("weight", "weight"), cell("color", "color"), F.lit("</edge>"))
    rows = edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", F.col("motif").cast("string"), "feature").alias("name"), line.alias("value"))
    return fixed.unionByName(nodes).unionByName(rows).select(F.struct("part", "name").alias("place"), "value")


def write_graphml(edges: DataFrame, path: str) -> None:
    """A GraphML document as the one file of a folder; it is streamed through one task, as a viewer takes it."""
    graphml_lines(edges).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
