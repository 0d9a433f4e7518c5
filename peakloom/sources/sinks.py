"""Writers and stores: motif text, the motif store, run folders, bundles, extracted scans, result tables, mzML, library look-ups."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import json
import os
import re
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .readers import exploded_motifs, grouped_motifs, write_table

WHOLE = ("scan", "ms1scan", "charge", "mslevel")


def write_m2m(motifs: DataFrame, path: str) -> None:
    """A text file's lines for each motif, one motif after the other, under a folder partitioned by motif."""
    number = lambda c: F.col(c).cast("string")
    line = F.when(F.col("frag_mz").isNotNull(), F.concat(F.lit("fragment_"), number("frag_mz"), F.lit(","), number("frag_intens"))).otherwise(F.concat(F.lit("loss_"), number("loss_mz"), F.lit(","), number("loss_intens")))
    rows = motifs.groupBy("motif_id").agg(F.max("annotation").alias("annotation"), F.array_sort(F.collect_list(F.struct("peak_idx", line.alias("t")))).alias("p"))
    head = F.concat(F.lit("#NAME "), "motif_id", F.lit("\n#ANNOTATION "), F.coalesce("annotation", F.lit("")))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n"))
    rows.select("motif_id", text.alias("value")).repartition("motif_id").write.partitionBy("motif_id").text(path)


def write_motifs(motifs: DataFrame, path: str) -> None:
    """The motif store: a JSON line for each motif, features as arrays."""
    grouped_motifs(motifs).write.json(path)


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Named tables, such as ms1 and ms2 of a motif store, side by side under a folder."""
    for name, df in tables.items():
        df.write.parquet(f"{folder.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


STORE = "scan string, motif_id string, annotation string, frag_mz array<double>, frag_intens array<double>, loss_mz array<double>, loss_intens array<double>"


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    return exploded_motifs(spark.read.schema(STORE).json(path))


def cached(spark: SparkSession, source: str, folder: str, read) -> DataFrame:
    """read(spark, source), kept as Parquet under folder by the file's name; a folder without its mark of success is written anew."""
    path = f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9.]+', '_', source)}.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        read(spark, source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


LONG_NAME = 80


def safe_path(path: str) -> str:
    """path, its last part cut to its last 80 characters behind a prefix of its own if it is longer."""
    folder, _, name = path.rpartition("/")
    if len(name) <= LONG_NAME:
        return path
    short = f"{hashlib.md5(name.encode()).hexdigest()}_{name[-LONG_NAME:]}"
    return f"{folder}/{short}" if folder else short


def results_table(results: DataFrame, path: str, kind: str = "csv", filename: str | None = None, original_path: str | None = None) -> None:
    """Query results with whole numbers in the scan columns where they are numbers, a band of 10 around `comment`, and the names of their file."""
    out = results
    for c in WHOLE:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("double").try_cast("bigint").cast("string"), F.col(c).cast("string")))
    if "comment" in out.columns:
        x = F.col("comment").try_cast("double")
        out = out.withColumns({"mz_lower": x - 10, "mz_upper": x + 10})
    for name, value in (("filename", filename and filename.rpartition("/")[2]), ("original_path", original_path)):
        if value is not None:
            out = out.withColumn(name, F.lit(value))
    write_table(out, safe_path(path), kind)


def extracted(peaks: DataFrame, results: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Peaks (file, scan, ...) of the scans in results (file, scan, ...) as one row a scan: new_scan from 1 and peaks by m/z.

    The first `limit` scans by file and scan, or all; a result that repeats a scan is taken once.
    """
    wanted = numbered(results.dropDuplicates(["file", "scan"]), "file", F.col("scan").try_cast("bigint").asc_nulls_last(), "scan", name="_n")
    wanted = wanted.withColumn("new_scan", (F.col("_n") + 1).cast("int")).drop("_n")
    wanted = wanted if limit is None else wanted.filter(F.col("new_scan") <= limit)
    spectra = peaks.join(wanted.select("file", "scan"), ["file", "scan"], "left_semi").groupBy("file", "scan").agg(F.array_sort(F.collect_list(F.struct(F.col("frag_mz").alias("mz"), F.col("frag_intens").alias("i")))).alias("peaks"))
    return wanted.join(spectra, ["file", "scan"])


def write_mzml(spectra: DataFrame, path: str) -> None:
    """extracted() scans as mzML documents, one for each partition, in a folder of text files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["value"])
        begun = False
        for b in batches:
            if len(b) and not begun:
                begun = True
                yield lines("<mzML><run><spectrumList>")
            yield lines(*map(spectrum, b["new_scan"].to_pylist(), b["precmz"].to_pylist(), b["peaks"].to_pylist()))
        if begun:
            yield lines("</spectrumList></run></mzML>")

    spectra.select("new_scan", F.col("precmz").cast("double").alias("precmz"), "peaks").mapInArrow(rows, "value string").write.text(path)


def spectrum(scan: int, precursor: float | None, peaks: list[dict]) -> str:
    arrays = []
    for name, key in (("m/z array", "mz"), ("intensity array", "i")):
        data = base64.b64encode(struct.pack(f"<{len(peaks)}d", *(p[key] for p in peaks))).decode()
        arrays.append(f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="no compression"/><cvParam name="{name}"/><binary>{data}</binary></binaryDataArray>')
    ion = "" if precursor is None else f'<cvParam name="selected ion m/z" value="{precursor!r}"/>'
    return f'<spectrum id="scan={scan}"><cvParam name="ms level" value="2"/>{ion}{"".join(arrays)}</spectrum>'


def write_bundle(path: str, tables: dict[str, list[dict]]) -> None:
    """Small tables of a viewer as one gzipped JSON object; the caller collects them, as they fit a browser."""
    with gzip.open(path, "wt", encoding="utf-8") as f:
        json.dump(tables, f)


def read_bundle(content: bytes | str) -> dict[str, list[dict]]:
    """A bundle from its bytes, plain or gzipped, or from base64 text (with or without a data: head)."""
    raw = base64.b64decode(content.rpartition(",")[2]) if isinstance(content, str) else content
    return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


def run_folder(base: str, name: str, spark: SparkSession | None = None) -> str:
    """A new folder base/name, or name_1, name_2, ... if there is one; with a session, on the file system of base, which all machines see."""
    for k in range(1 << 20):
        path = f"{base.rstrip('/')}/{name if k == 0 else f'{name}_{k}'}"
        if spark is None:
            try:
                os.makedirs(path)
                return path
            except FileExistsError:
                continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            system.mkdirs(folder)
            return path
    raise FileExistsError(name)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on the file system of its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def library_rows(database: str, table: str, key: str, keys: list) -> list[tuple]:
    """Rows of a SQLite library by key, in the order of keys; missing ones are left out."""
    return [rows[0] for rows in _looked_up(database, table, key, keys) if rows]


def _looked_up(database: str, table: str, key: str, keys: list) -> list[list[tuple]]:
    """The rows of each key, several hundred keys a statement."""
    if not re.fullmatch(r"\w+", table) or not re.fullmatch(r"\w+", key):
        raise ValueError("names of tables and columns are words")
    found: dict[object, list[tuple]] = {}
    with contextlib.closing(sqlite3.connect(f"file:{database}?mode=ro", uri=True)) as c:
        for at in range(0, len(keys), KEYS_AT_ONCE):
            part = keys[at : at + KEYS_AT_ONCE]
            cursor = c.execute(f"select {key}, * from {table} where {key} in ({', '.join('?' * len(part))})", part)
            for k, *row in cursor:
                found.setdefault(k, []).append(tuple(row))
    return [found.get(k, []) for k in keys]


KEYS_AT_ONCE = 500


def library_join(keys: DataFrame, column: str, database: str, table: str, key: str, columns: str) -> DataFrame:
    """keys joined with the rows of a SQLite library, by id, formula or any other column; columns: the library's own, as a schema.

    Each task asks the file, which all machines must see, for its own keys.
    """
    names = [c.split(" ")[0] for c in columns.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _looked_up(database, table, key, b[column].to_pylist())
            at = pa.array([k for k, hits in enumerate(found) for _ in hits], pa.int64())
            flat = [row for hits in found for row in hits]
            yield pa.RecordBatch.from_arrays([*(x.take(at) for x in b.columns), *(pa.array([row[k] for row in flat]) if flat else pa.nulls(0) for k in range(len(names)))], [*b.schema.names, *names])

    return keys.mapInArrow(rows, schema)
