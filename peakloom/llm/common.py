"""Session settings, inputs and shared folders of the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: texts can be long, and a Python worker holds a few batches at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names; a local one only where all run in one process."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/peakloom-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and no lost executor reruns it."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing still to be computed reads, and let Spark drop the shuffles of the steps behind them.

    Only for tables all of whose readers are settled themselves: a lost executor then needs none of them.
    """
    spark = tables[0].sparkSession
    for table in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(table.settled_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    spark._jvm.System.gc()  # Spark's cleaner removes shuffle files once their owners are collected


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as make it differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def crc_rest(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null keys get null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def least_hashed(df: DataFrame, hashed: Column, limit: int, *ties: str) -> DataFrame:
    """The rows of df with the `limit` least values of a 64-bit hash, ties by other columns.

    Rows beyond a cut that leaves some more than `limit` are dropped where they are, so that no task is handed `limit` rows of every
    partition. Keys that many rows share may leave fewer.
    """
    n = df.count()
    wanted = limit + 6 * math.sqrt(limit) + 50
    kept = df.filter(hashed < F.lit(int(-(1 << 63) + (wanted / n) * 2.0**64))) if n > 2 * wanted else df
    return kept.orderBy(hashed, *ties).limit(limit)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text's content; null and empty texts share one key."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shuffled_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join of tables that grow with the documents: never a broadcast, at any size, so one plan holds from small inputs to large ones.

    `small` has unique keys, so adaptive execution can split keys that crowd on the big side.
    """
    return big.join(small.hint("merge"), on, how)
