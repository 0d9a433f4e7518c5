"""From raw documents to token records: quality, one of each near-duplicate group, decontamination, mixing, binary output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm import decontaminate, jaccard, mixing, quality, records
from peakloom.llm.common import documents, settle, tune


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality.

    Null and empty texts are scored like any other; ties count as `quality` says; repeated rows go or stay together; without
    labelled rows every score is 0.5, so none stays; an empty table stays empty; all columns are handed on, whatever their names.
    """
    tune(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Null and empty texts and rows without a doc_id have no group and stay; of rows that share a doc_id one of each text stays; an
    empty table stays empty; all columns are handed on.
    """
    tune(spark)
    return jaccard.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts, and rows without a doc_id, are judged by their text alone; repeated rows go or stay together; an empty
    table on either side takes nothing away; all columns are handed on.
    """
    tune(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice.

    Texts without words, null ones included, are not taken; a null source is a source; repeated rows are documents of their own;
    an empty table stays empty; all columns are handed on.
    """
    tune(spark)
    return mixing.resample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end alone; null doc_ids come first; rows that share a doc_id, copies by the mix included, follow
    each other; an empty table gives an empty result; other columns are left out.
    """
    tune(spark)
    return records.encode(docs)


STAGES = [("quality", keep_quality), ("near-duplicates", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("records", encoded)]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
