"""Spectra and motif files as peak tables, and back.

Text formats are split into blocks by Spark's reader and parsed with SQL functions; mzML and mzXML, which are XML with encoded
arrays, are cut by it into spectra, and these are parsed into Arrow batches. Scans of different files are different scans.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .elements import json_objects

READERS = {}
NUMBER = r"[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[0-9]+\."
PEAK = rf"(?m)(?:^|;)[ \t]*({NUMBER})[ \t,:]+({NUMBER})"  # several on a line are parted by semicolons


def reader(*suffixes: str):
    def keep(f):
        READERS.update(dict.fromkeys(suffixes, f))
        return f

    return keep


def read_spectra(spark: SparkSession, source: str | DataFrame | list[dict]) -> DataFrame:
    """Peak rows of a table, of spectra in memory (dicts with mz and intensities, and scan, precmz, rt, charge, polarity), or of any known format, by suffix."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spectra_in_memory(spark, source)
    suffix = "." + source.lower().rpartition(".")[2]
    if suffix not in READERS:
        raise ValueError(f"unknown format: {source}")
    return READERS[suffix](spark, source)


def spectra_in_memory(spark: SparkSession, spectra: list[dict]) -> DataFrame:
    rows = [(str(x.get("scan", k + 1)), x.get("precmz"), x.get("rt"), int(x.get("charge", 1)), int(x.get("polarity", 0)), n, float(m), float(i)) for k, x in enumerate(spectra) for n, (m, i) in enumerate(zip(x["mz"], x["intensities"], strict=True))]
    return with_norms(spark.createDataFrame(rows, "scan string, precmz double, rt double, charge int, polarity int, peak_idx int, frag_mz double, frag_intens double").filter("frag_intens > 0"))


def _field(block: Column, name: str) -> Column:
    value = F.trim(F.regexp_extract(block, rf"(?im)^{name}[=:][ \t]*(.*)$", 1))
    return F.when(value != "", value)


#: Into how many parts to deal the scans of a split of a text file: with short lines a split of 128 MB has five million peaks.
PARTS_OF_SPLIT = 16


def _peaks(df: DataFrame, splits: int | None = None) -> DataFrame:
    """df (file, scan, block, ...) with a row for each peak of positive intensity.

    Norms are taken over a file's blocks of one scan name, whose peaks are in arrays until then. Where the number of splits is given, scans
    are dealt into so many parts that a task sorts little; else they are shuffled only where norms are asked for.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("block", F.lit(PEAK), F.lit(1)).alias("m"), F.regexp_extract_all("block", F.lit(PEAK), F.lit(2)).alias("v"))
    numbers = F.transform(pairs, lambda x, k: F.struct(k.alias("k"), x["m"].cast("double").alias("m"), x["v"].cast("double").alias("v")))
    kept = [c for c in df.columns if c != "block"]
    blocks = df.select(*kept, F.filter(numbers, lambda x: x["v"] > 0).alias("p"))
    blocks = blocks if splits is None else blocks.repartition(splits * PARTS_OF_SPLIT, "file", "scan")
    scan = Window.partitionBy("file", "scan")
    most = F.max(F.array_max(F.col("p.v"))).over(scan)
    total = F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["v"])).over(scan)
    # outer: else Spark infers a filter that parses every block again; a block without peaks has nulls, which the last filter drops
    out = blocks.withColumns({"most": most, "total": total}).select(*kept, "most", "total", F.explode_outer("p").alias("p"))
    own = out.select(*kept, F.col("p.k").alias("peak_idx"), F.col("p.m").alias("frag_mz"), F.col("p.v").alias("frag_intens"), "most", "total").filter("frag_intens > 0")
    return own.withColumns({"i_norm": F.col("frag_intens") / F.col("most"), "i_tic_norm": F.col("frag_intens") / F.col("total")}).drop("most", "total")


def with_norms(df: DataFrame) -> DataFrame:
    scan = Window.partitionBy(*(c for c in ("file", "scan") if c in df.columns))
    return df.withColumns({"i_norm": F.col("frag_intens") / F.max("frag_intens").over(scan), "i_tic_norm": F.col("frag_intens") / F.sum("frag_intens").over(scan)})


def _read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, split, value, id): a file's rows; ids go up by one inside a split."""
    return spark.read.text(path, **options).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("id"))


def _starts(read: DataFrame, count: Column) -> DataFrame:
    """(file, split, first, before): a row for each split: its first id, and the file's `count` over the splits before it."""
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    each = read.groupBy("file", "split").agg(F.min("id").alias("first"), count.alias("own"))
    return each.select("file", "split", "first", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("before"))


def _rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, value, n): a file's rows with their places from 1, whatever the splits it is read in.

    A row's place in its split is its id less the split's first, so no rows are sorted or shuffled for it.
    """
    read = _read(spark, path, **options)
    starts = F.broadcast(_starts(read, F.count("*")))  # a row for each split
    return read.join(starts, ["file", "split"]).select("file", "value", (F.col("id") - F.col("first") + F.col("before") + 1).alias("n"))


def _named(df: DataFrame, name: Column) -> Column:
    """A scan's name: of several files, with its file's."""
    own = F.coalesce(name, F.col("n").cast("string"))
    return F.concat_ws(":", F.substring_index("file", "/", -1), own) if len(df.inputFiles()) > 1 else own


@reader(".mgf")
def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra between BEGIN IONS and END IONS; without SCANS a spectrum is named by its place in its file."""
    splits = spark.read.text(path).rdd.getNumPartitions()
    rows = _rows(spark, path, lineSep="END IONS").withColumnRenamed("value", "block").filter(F.col("block").contains("BEGIN IONS"))
    named = rows.select(
        "file",
        _named(rows, _field(F.col("block"), "SCANS")).alias("scan"),
        F.regexp_extract(_field(F.col("block"), "PEPMASS"), r"^([0-9.]+)", 1).try_cast("double").alias("precmz"),
        (_field(F.col("block"), "RTINSECONDS").try_cast("double") / 60).alias("rt"),
        F.coalesce(F.regexp_extract(_field(F.col("block"), "CHARGE"), r"(\d+)", 1).try_cast("int"), F.lit(1)).alias("charge"),
        polarity(_field(F.col("block"), "IONMODE")).alias("polarity"),
        F.regexp_replace("block", r"(?m)^[^\n]*[=][^\n]*$", "").alias("block"),
    )
    return _peaks(named, splits)


def polarity(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.startswith("pos") | (low == "+"), 1).when(low.startswith("neg") | (low == "-"), 2).otherwise(0)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (head, value, blank), of which a split's first has its head, as blocks of lines without a blank one between them.

    k: how many blank lines of the file stand before a block; edge: the split's first or last, which may go on in another.
    """
    own, k, at, held, out = None, 0, 0, [], []

    def done(last: bool) -> None:
        if held:
            out.append((own["file"], own["split"], own["before"] + at, "\n".join(held), last or at == 0))
            held.clear()

    for b in batches:
        if not len(b):
            continue
        begins = np.flatnonzero(b["head"].is_valid().to_numpy(zero_copy_only=False))
        bounds = np.unique(np.concatenate([[0], begins, [len(b)]]))
        blank = b["blank"].to_numpy(zero_copy_only=False)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b["head"][low].is_valid:
                done(True)
                own, k, at = b["head"][low].as_py(), 0, 0
            gaps = blank[low:high]
            numbers = (k + np.cumsum(gaps))[~gaps]
            k += int(gaps.sum())
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            lines = b["value"].slice(low, high - low).filter(pa.array(~gaps))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(lines)), pa.int32()), lines), "\n")
            for number, text in zip(numbers[first].tolist(), texts.to_pylist(), strict=True):
                if number != at:
                    done(False)
                    at = number
                held.append(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], PARTED_NAMES)
            out.clear()
    done(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], PARTED_NAMES)


PARTED = "file string, split bigint, k bigint, block string, edge boolean"
PARTED_NAMES = [c.split(" ")[0] for c in PARTED.split(", ")]


@reader(".msp")
def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Compounds parted by blank lines, with any line ends; several peaks of a line are parted by semicolons, quoted notes are left out.

    Blocks are put together where their lines are read; only those at the edges of splits, two of each, are shuffled.
    """
    lines = _read(spark, path)
    blank = F.trim("value") == ""
    starts = F.broadcast(_starts(lines, F.sum(blank.cast("int"))))  # a row for each split
    head = F.when(F.col("id") == F.col("first"), F.struct("file", "split", "before"))
    parted = lines.join(starts, ["file", "split"]).select(head.alias("head"), "value", blank.alias("blank")).mapInArrow(_parted, PARTED)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "block"))), lambda x: x["block"]), "\n")
    edges = parted.filter("edge").groupBy("file", "k").agg(joined.alias("block"))
    blocks = parted.filter("not edge").select("file", "k", "block").unionByName(edges).filter(F.lower("block").contains("num peaks"))
    blocks = blocks.withColumn("n", F.col("k") + 1)
    named = blocks.select(
        "file",
        _named(lines, _field(F.col("block"), "NAME")).alias("scan"),
        _field(F.col("block"), "PRECURSOR_?MZ").try_cast("double").alias("precmz"),
        polarity(_field(F.col("block"), "ION_?MODE")).alias("polarity"),
        F.regexp_replace(F.regexp_replace("block", r'"[^"\n]*"', ""), r"(?m)^[^\n]*[A-Za-z][^\n]*:[^\n]*$", "").alias("block"),
    )
    return _peaks(named)


@reader(".txt", ".dat")
def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """Two columns of m/z and intensity: one MS1 scan."""
    parts = F.split(F.trim("value"), r"\s+")
    out = spark.read.text(path).select(F.lit("1").alias("scan"), parts[0].try_cast("double").alias("mz"), parts[1].try_cast("double").alias("i"), F.lit(0.0).alias("rt"), F.lit(1).alias("polarity")).filter("mz is not null and i > 0")
    scan = Window.partitionBy("scan")
    return out.withColumns({"i_norm": F.col("i") / F.max("i").over(scan), "i_tic_norm": F.col("i") / F.sum("i").over(scan)})


LIBRARY = "spectrum_id string, peaks_json string, Precursor_MZ string"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark, path).select(F.from_json("text", LIBRARY).alias("e")).select("e.*")


@reader(".json")
def read_library(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON array of library spectra with peaks_json, read by as many tasks as it has splits.

    Where a limit is given, entries of more characters are passed over; left_out tells how many.
    """
    rows = _entries(spark, path)
    kept = rows if limit is None else rows.filter(F.length("peaks_json") <= limit)
    peaks = kept.select(F.col("spectrum_id").alias("scan"), F.col("Precursor_MZ").try_cast("double").alias("precmz"), F.posexplode(F.from_json("peaks_json", "array<array<double>>")).alias("peak_idx", "p"))
    return with_norms(peaks.select("scan", "precmz", "peak_idx", F.col("p")[0].alias("frag_mz"), F.col("p")[1].alias("frag_intens")).filter("frag_intens > 0"))


def left_out(spark: SparkSession, path: str, limit: int) -> int:
    """How many entries read_library passes over under a limit."""
    return _entries(spark, path).filter(F.length("peaks_json") > limit).count()


#: Of one spectrum; ms1: the last MS1 scan with a peak up to it, in its split; place: its number in its split.
SPECTRUM = "scan string, ms_level int, mz array<double>, i array<double>, rt double, polarity int, precmz double, charge int, mobility double, place bigint, ms1 struct<scan:string,place:bigint>, file string, split bigint"
SPECTRUM_NAMES = [c.split(" ")[0] for c in SPECTRUM.split(", ")]
SPECTRUM_KINDS = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.struct([("scan", pa.string()), ("place", pa.int64())]), pa.string(), pa.int64()]
PEAKS_AT_ONCE = 1 << 16
MOBILITY = ("product ion mobility", "ion mobility drift time", "inverse reduced ion mobility")


def _floats(text: str | None, precision: int, packed: bool, order: str) -> np.ndarray:
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if packed and raw else raw
    return np.frombuffer(raw, f"{order}f{precision // 8}").astype(float)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


Spectrum = tuple[str | None, int, np.ndarray, np.ndarray, float | None, int, float | None, int, float | None]


def _mzml(text: str) -> Spectrum | None:
    """One spectrum with an MS level: scan, level, m/z, intensities, minutes, polarity, precursor, charge, mobility."""
    e = ET.fromstring(text)
    params = {p.get("name"): p for p in e.iter() if _tag(p) == "cvParam"}
    if "ms level" not in params:
        return None
    time = params.get("scan start time")
    value = lambda name: float(params[name].get("value")) if name in params else None
    arrays = {}
    for a in (x for x in e.iter() if _tag(x) == "binaryDataArray"):
        names = {p.get("name") for p in a.iter() if _tag(p) == "cvParam"}
        data = next((b.text for b in a.iter() if _tag(b) == "binary"), None)
        arrays["mz" if "m/z array" in names else "i"] = _floats(data, 64 if "64-bit float" in names else 32, "zlib compression" in names, "<")
    return (
        e.get("id", "").rpartition("scan=")[2].split(" ")[0] or None, int(params["ms level"].get("value")), arrays.get("mz", np.zeros(0)), arrays.get("i", np.zeros(0)),
        float(time.get("value")) / (60 if time.get("unitName") == "second" else 1) if time is not None else None,
        1 if "positive scan" in params else 2 if "negative scan" in params else 0,
        value("selected ion m/z"), int(value("charge state") or 0), next((v for v in map(value, MOBILITY) if v is not None), None),
    )


def _mzxml(text: str) -> Spectrum | None:
    """One scan up to the end of its peaks, before the scans it holds."""
    e = ET.fromstring(text)
    own = {_tag(x): x for x in e}
    peaks, precursor = own["peaks"], own.get("precursorMz")
    values = _floats(peaks.text, int(peaks.get("precision", 32)), peaks.get("compressionType") == "zlib", ">")
    mz, charge = (float(precursor.text), int(precursor.get("precursorCharge", 0))) if precursor is not None else (None, 0)
    rt = float(e.get("retentionTime", "PT0S").strip("PTS") or 0) / 60
    return e.get("num"), int(e.get("msLevel")), values[::2], values[1::2], rt, {"+": 1, "-": 2}.get(e.get("polarity"), 0), mz, charge, None


#: By format: what spectra are cut at, how one begins, what closes it again, and its parser.
RAW = {"mzml": ("</spectrum>", re.compile(r"<spectrum\s"), "</spectrum>", _mzml), "mzxml": ("</peaks>", re.compile(r"<scan\s"), "</peaks></scan>", _mzxml)}


@reader(".mzml", ".mzxml")
def read_raw(spark: SparkSession, path: str, least: float = 0.0, top: int | None = None) -> DataFrame:
    """Peaks of every level with ms1scan, the last MS1 scan that had a peak.

    least: peaks with an m/z or intensity below it are left out; top: of MS2 scans the most intense peaks that stay. A file is read by as many
    tasks as it has splits: Spark's text reader cuts it behind each spectrum's data. In a split spectra come in order; what goes
    over its edge, how many there were and the last MS1 scan, is put together from one row for each split.
    """
    between, begin, end, parse = RAW[path.lower().rpartition(".")[2]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, ms1 = None, 0, None
        held, n = [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), SPECTRUM_KINDS, strict=True)], SPECTRUM_NAMES)
        for b in batches:
            for file, split, text in zip(*(b[c].to_pylist() for c in ("file", "split", "value")), strict=True):
                if (file, split) != own:
                    own, place, ms1 = (file, split), 0, None
                start = [m.start() for m in begin.finditer(text)]
                if not start:
                    continue  # what follows the last spectrum
                place += 1
                if (found := parse(text[start[-1] :] + end)) is None:
                    found, peaks = (None, None, [], [], None, None, None, None, None), 0
                else:
                    scan, level, mz, i, *rest = found
                    keep = np.flatnonzero((i[: len(mz)] > 0) & (mz[: len(i)] >= least) & (i[: len(mz)] >= least))
                    if top is not None and level == 2 and len(keep) > top:
                        keep = np.sort(keep[np.argsort(i[keep], kind="stable")[-top:]])
                    found, peaks = (scan, level, mz[keep], i[keep], *rest), len(keep)
                    if level == 1 and peaks:
                        ms1 = {"scan": scan, "place": place}
                held.append((*found, place, ms1, file, split))
                n += peaks
                if n >= PEAKS_AT_ONCE or len(held) >= PEAKS_AT_ONCE:
                    yield table()
                    held, n = [], 0
        if held:
            yield table()

    text = spark.read.text(path, lineSep=between).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    spectra = text.mapInArrow(rows, SPECTRUM)
    ends = spectra.groupBy("file", "split").agg(F.max("place").alias("places"), F.max_by("ms1", "place").alias("last"))
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("places").over(ahead), F.lit(0)))
    name = lambda s, place: F.coalesce(s, (F.col("before") + place).cast("string"))
    ends = ends.withColumn("last", F.when(F.col("last").isNotNull(), name(F.col("last.scan"), F.col("last.place")))).withColumn("ahead", F.last("last", True).over(ahead))
    placed = spectra.join(F.broadcast(ends.select("file", "split", "before", "ahead")), ["file", "split"])  # a row for each split
    peaks = placed.select(
        name(F.col("scan"), F.col("place")).alias("scan"), "ms_level", F.inline(F.arrays_zip("mz", "i")).alias("mz", "i"), "rt", "polarity", "precmz", "charge", "mobility",
        (F.col("before") + F.col("place")).alias("n"), "file",
        F.coalesce(F.when(F.col("ms1").isNotNull(), name(F.col("ms1.scan"), F.col("ms1.place"))), F.col("ahead")).alias("ms1scan"),
    )
    return peaks


def read_m2m(spark: SparkSession, path: str) -> DataFrame:
    """Motif text files: #KEY value headers, then fragment_<mz>,<p> and loss_<mz>,<p>."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    line = r"(?m)^(fragment|loss)_([0-9.]+),([0-9.eE+-]+)"
    cells = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(line), F.lit(k)).alias(n) for k, n in ((1, "kind"), (2, "mz"), (3, "p"))))
    out = files.select(F.coalesce(_header("NAME"), F.col("file")).alias("motif_id"), _header("ANNOTATION").alias("annotation"), F.posexplode(cells).alias("peak_idx", "c"))
    return _disjoint(out.select("motif_id", "annotation", "peak_idx", "c.kind", F.round(F.col("c.mz").cast("double"), 3).alias("mz"), F.col("c.p").cast("double").alias("p")))


def _header(name: str) -> Column:
    value = F.trim(F.regexp_extract("value", rf"(?im)^#{name}[ \t]+(.*)$", 1))
    return F.when(value != "", value)


def _disjoint(df: DataFrame) -> DataFrame:
    """kind, mz, p as the motif table's columns: a row is a fragment or a loss, the other pair is null."""
    fragment = F.col("kind") == "fragment"
    return df.select(
        F.md5("motif_id").alias("scan"), "motif_id", "annotation", "peak_idx",
        F.when(fragment, F.col("mz")).alias("frag_mz"), F.when(fragment, F.col("p")).alias("frag_intens"),
        F.when(~fragment, F.col("mz")).alias("loss_mz"), F.when(~fragment, F.col("p")).alias("loss_intens"),
    )


def grouped_motifs(peaks: DataFrame) -> DataFrame:
    """One row for each motif with equal-length arrays, the nested form of the motif store."""
    parts = ["peak_idx", "frag_mz", "frag_intens", "loss_mz", "loss_intens"]
    grouped = peaks.groupBy("scan", "motif_id", "annotation").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("p"))
    return grouped.select("scan", "motif_id", "annotation", *(F.col("p").getField(c).alias(c) for c in parts[1:]))


def exploded_motifs(nested: DataFrame) -> DataFrame:
    """The inverse of grouped_motifs; NaN becomes null."""
    parts = ["frag_mz", "frag_intens", "loss_mz", "loss_intens"]
    rows = nested.select("scan", "motif_id", "annotation", F.posexplode(F.arrays_zip(*parts)).alias("peak_idx", "p"))
    return rows.select("scan", "motif_id", "annotation", "peak_idx", *(F.nanvl(F.col(f"p.{c}"), F.lit(None)).alias(c) for c in parts))


def write_mgf(peaks: DataFrame, path: str) -> None:
    """One block for each scan, peaks ascending in m/z."""
    line = F.transform("p", lambda x: F.format_string("%.4f %.4f", x["frag_mz"], x["frag_intens"]))
    blocks = peaks.groupBy("scan").agg(F.max("precmz").alias("precmz"), F.max("rt").alias("rt"), F.array_sort(F.collect_list(F.struct("frag_mz", "frag_intens"))).alias("p"))
    text = F.concat(F.lit("BEGIN IONS\nSCANS="), "scan", F.lit("\nPEPMASS="), F.coalesce(F.format_string("%.4f", "precmz"), F.lit("0")), F.lit("\nRTINSECONDS="), F.coalesce(F.format_string("%.3f", F.col("rt") * 60), F.lit("0")), F.lit("\n"), F.array_join(line, "\n"), F.lit("\nEND IONS\n"))
    blocks.select(text.alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Columns in order of name, as CSV, TSV, JSON lines or Parquet."""
    out = df.select(*sorted(df.columns))
    if kind in ("csv", "tsv"):
        out.write.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        out.write.format(kind).save(path)
