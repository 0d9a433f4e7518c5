"""Peak tables derived from the order tables: one MS2 spectrum for each order, one MS1 scan for each customer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MS2_SQL = """
select cast(l.l_orderkey as varchar(20)) as scan, cast(o.o_custkey as varchar(20)) as ms1scan,
       l.l_extendedprice/100.0e0 as frag_mz, l.l_quantity as frag_intens,
       case when (o.o_totalprice-l.l_extendedprice)/100.0e0 > 0.01e0 then (o.o_totalprice-l.l_extendedprice)/100.0e0 end as loss_mz,
       case when (o.o_totalprice-l.l_extendedprice)/100.0e0 > 0.01e0 then l.l_quantity end as loss_intens,
       o.o_totalprice/100.0e0 as precmz,
       extract(month from o.o_orderdate)*1.0e0 + extract(day from o.o_orderdate)/100.0e0 as rt,
       case o.o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as polarity,
       1 + o.o_custkey % 3 as charge, concat('motif_', cast(l.l_orderkey as varchar(20))) as motif_id,
       c.c_mktsegment as motifset, o.o_orderpriority as short_annotation
from lineitem l join orders o on l.l_orderkey=o.o_orderkey join customer c on o.o_custkey=c.c_custkey
"""
MS1_SQL = """
select scan, mz, i, i/max(i) over (partition by scan) as i_norm, i/sum(i) over (partition by scan) as i_tic_norm, rt, polarity
from (select cast(o_custkey as varchar(20)) as scan, o_totalprice/100.0e0 as mz,
             (cast(floor(o_totalprice) as bigint) % 997 + 1)*1.0e0 as i, o_custkey/100.0e0 as rt, o_custkey%2+1 as polarity from orders) t
"""
WORDS_SQL = """
select scan, word, cast(sum(n) as bigint) as n from (
  select scan, concat('frag@', cast(floor(frag_mz*100e0+0.5e0)/100e0 as varchar(30))) as word, {half_even} as n
  from (select scan, frag_mz, frag_intens/max(frag_intens) over (partition by scan) as w from ms2) a) b
where n > 0 group by scan, word
"""


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A statement over tables of sf_dir, which leaves no views in the session."""
    for name in names:
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names})


def ms2_peaks(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """keyed: with the order's number as _key, by which the join of large tables has dealt the peaks, so that groups by _key and scan need no shuffle of their own."""
    sql = MS2_SQL.replace("select ", "select l.l_orderkey as _key, ", 1) if keyed else MS2_SQL
    return over(spark, sf_dir, sql, "lineitem", "orders", "customer")


def scan_parts(spark: SparkSession, sf_dir: str, rows: int = 250_000) -> int:
    """Into how many parts of about that many peaks to deal the scans; the count is in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // rows))


def ms1_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, MS1_SQL, "orders")


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, topic, p): rows of mixtures, from embeddings."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.posexplode("embedding").alias("topic", "e"))
    return normalised(cells.withColumn("e", F.abs(F.col("e").cast("double"))), "doc").select("doc", "topic", "p")


def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, word, p): the same cells normalised over topics; a word for each vector."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("word"), F.posexplode("embedding").alias("topic", "e"))
    return normalised(cells.withColumn("e", F.abs(F.col("e").cast("double"))), "topic").select("topic", "word", "p")


def normalised(cells: DataFrame, key: str) -> DataFrame:
    totals = cells.groupBy(key).agg(F.sum("e").alias("total"))
    return cells.join(totals, key).withColumn("p", F.col("e") / F.col("total"))
