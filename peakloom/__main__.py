"""Command line: peak queries over files, descriptions of queries, and topic runs."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotation, checkpoints, lda, motifs, network, peaks, runs, topics
from .operators.shared import settle
from .plans.compiler import run_many
from .plans.describe import describe
from .plans.drawing import curve, visualise
from .sources.readers import read_spectra
from .sources.sinks import results_table, run_folder, write_motifs, write_text

DEFAULTS = {"topics": 20, "iterations": 20, "digits": 2, "min_cf": 1, "min_df": 2, "low_mz": 0.0, "high_mz": 2000.0, "low": 0.01, "top": 1000, "least": 5, "top_words": 10, "motif_words": 50, "vocabulary_limit": 2_000_000, "library": None, "vector_size": 100}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, nested objects key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def tables(spark: SparkSession, path: str):
    """(ms1 or None, ms2) peak tables of a file; formats with several levels are parted by ms_level."""
    df = read_spectra(spark, path)
    if "ms_level" not in df.columns:
        return None, df
    ms1 = df.filter("ms_level = 1").select("scan", "mz", "i", "rt", "polarity")
    return ms1, df.filter("ms_level = 2").withColumnsRenamed({"mz": "frag_mz", "i": "frag_intens"})


def stored(made: DataFrame) -> DataFrame:
    """Motif spectra as the rows of a motif store."""
    return motifs.motif_tables(made)[1].withColumn("annotation", F.lit(None).cast("string"))


def topic_run(spark: SparkSession, path: str, folder: str, options: dict) -> None:
    """Clean, count words, fit and infer; theta and beta as Parquet, the model as checkpoints, the options as JSON."""
    spectra = tables(spark, path)[1]
    if "loss_mz" not in spectra.columns:
        spectra = spectra.withColumn("loss_mz", spectra["precmz"] - spectra["frag_mz"])
    kept = peaks.clean(spectra, options["low_mz"], options["high_mz"], options["low"], 1.0, options["top"], options["least"])
    corpus = peaks.words(kept, options["digits"], losses=True).withColumnRenamed("scan", "doc")
    corpus.write.parquet(f"{folder}/corpus")
    corpus = spark.read.parquet(f"{folder}/corpus")
    chosen = peaks.vocabulary(corpus.withColumnRenamed("doc", "scan"), options["min_cf"], options["min_df"]).orderBy("word").select("word")
    if chosen.count() > options["vocabulary_limit"]:
        raise ValueError("the vocabulary is larger than vocabulary_limit: raise min_cf or min_df, or lower digits")
    words = [r["word"] for r in chosen.toLocalIterator()]
    ids = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, id int")
    docs = settle(lda.bags(corpus, ids).repartition(spark.sparkContext.defaultParallelism), "bags")
    found = checkpoints.restore(f"{folder}/model")
    model = lda.fit(docs, words, options["topics"], options["iterations"], start=found[1] if found else None, after=lambda m: checkpoints.save(m, f"{folder}/model", len(m.history)), learn_alpha=True)
    lda.infer(docs, model).write.parquet(f"{folder}/theta")
    lda.table(spark, model).write.parquet(f"{folder}/beta")
    beta = spark.read.parquet(f"{folder}/beta")
    best = topics.top_words(beta, options["top_words"])
    best.write.json(f"{folder}/top_words")
    motifs.motif_spectra(topics.top_words(beta, options["motif_words"]), options["digits"]).write.parquet(f"{folder}/motifs")
    phi = lda.responsibilities(docs, model).join(ids, "id").select("doc", "word", "topic", "p")
    topics.overlap(beta, phi).write.parquet(f"{folder}/overlap")
    for name, part in topics.exported(spark.read.parquet(f"{folder}/theta"), beta, phi, gamma=lda.gammas(docs, model)).items():
        part.write.parquet(f"{folder}/viewer/{name}")
    made = spark.read.parquet(f"{folder}/motifs")
    write_motifs(stored(made), f"{folder}/motifset")
    corpus.select("doc").distinct().write.parquet(f"{folder}/doc2spec")
    write_text(spark, f"{folder}/convergence.svg", curve([c["perplexity"] for c in model.checks], "perplexity"))
    if options["library"]:
        vectors = annotation.word_vectors(corpus.groupBy("doc").agg(F.sort_array(F.collect_list("word")).alias("words")), options["vector_size"])
        hits, best = annotation.optimised_motifs(made, tables(spark, options["library"])[1], vectors, options["digits"])
        hits.write.parquet(f"{folder}/annotation")
        best.write.parquet(f"{folder}/motifs_optimised")
        write_motifs(stored(spark.read.parquet(f"{folder}/motifs_optimised")), f"{folder}/motifset_optimised")
    network.write_graphml(network.feature_edges(motifs.network_features(spark.read.parquet(f"{folder}/motifs"))), f"{folder}/network.graphml")
    write_text(spark, f"{folder}/run.json", json.dumps(runs.manifest(spark, options, path) | {"history": model.history, "checks": model.checks}))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("peakloom")
    commands = parser.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run queries over a file")
    q.add_argument("file")
    q.add_argument("query")
    q.add_argument("--output", required=True)
    q.add_argument("--format", choices=("csv", "tsv", "json", "parquet"), default="csv")
    q.add_argument("--original-path", help="where the file came from")
    d = commands.add_parser("describe", help="say a query in words")
    d.add_argument("query")
    g = commands.add_parser("draw", help="draw a query's bands as SVG")
    g.add_argument("query")
    for name, value in (("x", 500.0), ("y", 1.0), ("precursor", 800.0)):
        g.add_argument(f"--{name}", type=float, default=value)
    t = commands.add_parser("topics", help="find topics in a file of spectra")
    t.add_argument("file")
    t.add_argument("--output-folder", required=True)
    t.add_argument("--run-name")
    t.add_argument("--n-topics", type=int)
    t.add_argument("--n-iterations", type=int)
    t.add_argument("--library", help="spectra to annotate motifs from")
    t.add_argument("--config", help="JSON object of options")
    args = parser.parse_args(arguments)
    if args.command == "describe":
        print(describe(args.query))
        return 0
    if args.command == "draw":
        print(visualise(args.query, args.x, args.y, args.precursor))
        return 0
    spark = SparkSession.builder.appName("peakloom").getOrCreate()
    if args.command == "query":
        ms1, ms2 = tables(spark, args.file)
        results_table(run_many(args.query, ms1, ms2), args.output, args.format, args.file, args.original_path)
        return 0
    options = DEFAULTS
    if args.config:
        with open(args.config) as f:
            options = merged(options, json.load(f))
    options = merged(options, {k: v for k, v in (("topics", args.n_topics), ("iterations", args.n_iterations), ("library", args.library)) if v is not None})
    topic_run(spark, args.file, run_folder(args.output_folder, args.run_name or os.path.splitext(os.path.basename(args.file))[0], spark), options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
