"""Registered queries that write the given tables in a file format, in the shared folder, and read them again, each beside SQL over the tables."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.shared import fresh_folder
from .registry import PEAKS, q6, r6, register
from .sources import readers, sinks, strict
from .sources.adapters import ms1_peaks, ms2_peaks

SPECTRA = f"{PEAKS} select scan, {q6('max(precmz)')} as precmz, count(*) as n, {q6('max(frag_mz)')} as top, {q6('sum(frag_intens)')} as total from ms2 group by scan"


def folder(spark: SparkSession, suffix: str) -> str:
    return fresh_folder(spark, "files") + suffix


def spectra(peaks: DataFrame, scan: F.Column | str = "scan", *more: F.Column) -> DataFrame:
    """One row a scan, to be compared with SPECTRA; more: further sums."""
    return peaks.groupBy(F.col(scan).alias("scan") if isinstance(scan, str) else scan.alias("scan")).agg(r6(F.max("precmz")).alias("precmz"), F.count("*").alias("n"), r6(F.max("frag_mz")).alias("top"), r6(F.sum("frag_intens")).alias("total"), *more)


def named_scan() -> F.Column:
    """The scan's own name, without that of its file."""
    return F.substring_index("scan", ":", -1)


@register("files_mgf", f"{PEAKS} select scan, {q6('max(precmz)')} as precmz, count(*) as n, {q6('max(frag_mz)')} as top, {q6('sum(frag_intens)')} as total, {q6('max(frag_intens / t)')} as share from (select *, sum(frag_intens) over (partition by scan) as t from ms2) group by scan")
def files_mgf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, ".mgf")
    readers.write_mgf(ms2_peaks(spark, sf_dir), path)
    return spectra(readers.read_spectra(spark, path), named_scan(), r6(F.max("i_tic_norm")).alias("share"))


@register("files_msp", SPECTRA)
def files_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, ".msp")
    line = F.transform("p", lambda x: F.concat_ws(" ", x["frag_mz"].cast("string"), x["frag_intens"].cast("string")))
    blocks = ms2_peaks(spark, sf_dir).groupBy("scan").agg(F.max("precmz").alias("precmz"), F.collect_list(F.struct("frag_mz", "frag_intens")).alias("p"))
    blocks.select(F.concat(F.lit("Name: "), "scan", F.lit("\nPrecursor_MZ: "), F.col("precmz").cast("string"), F.lit("\nNum Peaks: "), F.size("p").cast("string"), F.lit("\n"), F.array_join(line, "\n"), F.lit("\n"))).write.text(path)
    return spectra(readers.read_spectra(spark, path), named_scan())


@register("files_columns", f"{PEAKS} select count(*) as n, {q6('sum(mz)')} as mz, sum(i)::bigint as i, {q6('max(i / t)')} as share from (select mz, i, sum(i) over () as t from ms1)")
def files_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, ".txt")
    ms1_peaks(spark, sf_dir).select(F.concat_ws("   ", F.col("mz").cast("string"), F.col("i").cast("string"))).write.text(path)
    return readers.read_spectra(spark, path).agg(F.count("*").alias("n"), r6(F.sum("mz")).alias("mz"), F.sum("i").cast("bigint").alias("i"), r6(F.max("i_tic_norm")).alias("share"))


@register("files_library", SPECTRA)
def files_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, ".json")
    peaks = F.to_json(F.collect_list(F.array("frag_mz", F.col("frag_intens").cast("double"))))
    entries = ms2_peaks(spark, sf_dir).groupBy(F.col("scan").alias("spectrum_id")).agg(peaks.alias("peaks_json"), F.max("precmz").cast("string").alias("Precursor_MZ"), F.lit('{"}').alias("note"))
    entries.write.json(path)
    return spectra(readers.read_spectra(spark, path))


@register("files_mzml", f"{PEAKS} select row_number() over (order by scan::bigint)::int as new_scan, scan, {q6('max(precmz)')} as precmz, count(*) as n, {q6('max(frag_mz)')} as top, {q6('sum(frag_intens)')} as total from ms2 group by scan")
def files_mzml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scans as results, numbered anew, written as documents and read again."""
    path = folder(spark, ".mzml")
    peaks = ms2_peaks(spark, sf_dir).withColumn("file", F.lit("f"))
    found = sinks.extracted(peaks, peaks.groupBy("file", "scan").agg(F.max("precmz").alias("precmz")), None)
    sinks.write_mzml(found, path)
    again = readers.read_spectra(spark, path).withColumnsRenamed({"mz": "frag_mz", "i": "frag_intens"})
    names = found.select(F.col("new_scan").cast("string").alias("scan"), "new_scan", F.col("scan").alias("name"))
    return spectra(again).join(names, "scan").select("new_scan", F.col("name").alias("scan"), "precmz", "n", "top", "total")


def scan_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans of (num, level, precursor, charge, polarity, rt, mz, i) as the elements of a raw file."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            data = base64.b64encode(np.column_stack([r["mz"], r["i"]]).astype(">f8").tobytes()).decode()
            before = f'<precursorMz precursorCharge="{r["charge"]}">{r["precursor"]!r}</precursorMz>' if r["level"] == 2 else ""
            out.append(f'<scan num="{r["num"]}" msLevel="{r["level"]}" polarity="{"+-"[r["polarity"] - 1] if r["polarity"] else ""}" retentionTime="PT{r["rt"] * 60!r}S">{before}<peaks precision="64">{data}</peaks></scan>')
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


@register("files_mzxml", f"{PEAKS}, f as (select scan, min(ms1scan) as ms1scan, 2 as ms_level, charge, polarity, {q6('max(precmz)')} as precmz, count(*) as n, {q6('sum(frag_mz)')} as mz from ms2 where frag_intens > 0 group by scan, charge, polarity) select * from f union all select 'c' || scan, 'c' || scan, 1, 0, polarity, null, count(*), {q6('sum(mz)')} from ms1 group by scan, polarity".replace("min(ms1scan) as ms1scan", "'c' || min(ms1scan) as ms1scan"))
def files_mzxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's scan before those of its orders, so a scan's ms1scan is its customer's, in whatever split of whatever file."""
    path = folder(spark, ".mzxml")
    listed = lambda mz, i: [F.sort_array(F.collect_list(F.struct(F.col(mz).alias("mz"), F.col(i).cast("double").alias("i")))).alias("p")]
    one = ms1_peaks(spark, sf_dir).groupBy("scan", "polarity", "rt").agg(*listed("mz", "i"))
    one = one.select(F.concat(F.lit("c"), "scan").alias("num"), F.col("scan").alias("of"), F.lit(1).alias("level"), F.lit(0.0).alias("precursor"), F.lit(0).alias("charge"), "polarity", "rt", "p")
    two = ms2_peaks(spark, sf_dir).groupBy("scan", "ms1scan", "charge", "polarity", "precmz", "rt").agg(*listed("frag_mz", "frag_intens"))
    two = two.select(F.col("scan").alias("num"), F.col("ms1scan").alias("of"), F.lit(2).alias("level"), F.col("precmz").cast("double").alias("precursor"), F.col("charge").cast("int").alias("charge"), "polarity", F.col("rt").cast("double").alias("rt"), "p")
    every = one.unionByName(two).withColumns({"mz": F.col("p.mz"), "i": F.col("p.i")}).drop("p")
    every.repartition("of").sortWithinPartitions("of", "level", "num").mapInArrow(scan_text, "value string").write.text(path)
    again = readers.read_spectra(spark, path)
    out = again.groupBy("scan", "ms1scan", "ms_level", "charge", "polarity").agg(r6(F.max("precmz")).alias("precmz"), F.count("*").alias("n"), r6(F.sum("mz")).alias("mz"))
    return out.withColumn("precmz", F.when(F.col("ms_level") == 2, F.col("precmz")))


@register("files_strict", "select o_custkey as cust, count(*) as records, count(*) filter (o_orderkey % 7 = 0) as unnamed, count(*) filter (o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 and o_custkey % 4 = 0) as bad_mass from orders group by 1")
def files_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of which some lack a name, a structure or a mass."""
    path = folder(spark, ".mgf")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    field = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("")), F.lit("\n"))
    text = F.concat(
        F.lit("BEGIN IONS\n"), field("USI", F.when(F.col("o_orderkey") % 7 != 0, key)), field("FEATURE_ID", F.col("o_custkey").cast("string")), field("SMILES", F.when(F.col("o_orderkey") % 5 != 0, F.lit("C"))), field("INCHIKEY", key),
        field("PRECURSOR_MZ", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("none"))), F.lit("100.5 1.0\nEND IONS\n"),
    )
    orders.select(text).write.text(path)
    records = strict.library_records(strict.read_strict(spark, path))
    of = lambda problem: F.count(F.when(F.col("problem") == problem, 1))
    return records.groupBy(F.col("feature_id").cast("bigint").alias("cust")).agg(F.count("*").alias("records"), of("no usi").alias("unnamed"), of("precursor_mz is no positive number").alias("bad_mass"))


@register("files_results", "select o_orderkey::varchar as scan, o_custkey::varchar as ms1scan, o_totalprice::double as comment, o_totalprice - 10e0 as mz_lower, o_totalprice + 10e0 as mz_upper, 'orders.mzML' as filename from orders")
def files_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select((F.col("o_orderkey").cast("double")).cast("string").alias("scan"), F.col("o_custkey").cast("string").alias("ms1scan"), F.col("o_totalprice").cast("double").alias("comment"))
    sinks.results_table(rows, path, "tsv", "/data/orders.mzML")
    read = spark.read.csv(sinks.safe_path(path), header=True, sep="\t")
    return read.select("scan", "ms1scan", *(F.col(c).cast("double").alias(c) for c in ("comment", "mz_lower", "mz_upper")), "filename")


@register("files_store", SPECTRA)
def files_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables side by side in a folder, and a cache of what was read from it."""
    path = folder(spark, "")
    sinks.write_tables(path, ms1=ms1_peaks(spark, sf_dir), ms2=ms2_peaks(spark, sf_dir))
    read = lambda session, source: sinks.read_tables(session, source, "ms2")["ms2"]
    cache = folder(spark, "-cache")
    sinks.cached(spark, path, cache, read)
    return spectra(sinks.cached(spark, path, cache, read))
