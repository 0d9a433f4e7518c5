"""MGF files checked line by line: errors as rows, and records that carry what a library needs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEEDED = ("usi", "feature_id", "smiles", "inchikey", "precursor_mz")


class MgfError(ValueError):
    def __init__(self, line: int | None, message: str) -> None:
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line, self.message = line, message


UNENDED, NESTED = "the last block has no end", "BEGIN IONS inside a block"


def blocks(lines: Iterator[str]) -> Iterator[tuple[dict[str, str], list[float], list[float]]]:
    """(fields, m/z, intensities) of every block; raises MgfError for whatever is not well formed."""
    fields: dict[str, str] | None = None
    mz: list[float] = []
    intensity: list[float] = []
    for number, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or fields is None and line[0] in "#;!/":
            continue
        if line == "BEGIN IONS":
            if fields is not None:
                raise MgfError(number, NESTED)
            fields, mz, intensity = {}, [], []
        elif line == "END IONS":
            if fields is None:
                raise MgfError(number, "END IONS without a block")
            yield fields, mz, intensity
            fields = None
        elif fields is None:
            raise MgfError(number, "content outside a block")
        elif "=" in line and not line[0].isdigit():
            key, _, value = line.partition("=")
            fields[key.strip().lower()] = value.strip()
        else:
            try:
                a, b = map(float, line.split()[:2])
            except ValueError:
                raise MgfError(number, "malformed peak") from None
            mz.append(a)
            intensity.append(b)
    if fields is not None:
        raise MgfError(None, UNENDED)


#: place: of a piece in its split; row: of a block in its split; line: an error's own, 0 where the piece ends inside a block; lines: of the piece and those
#: before it in its split.
PIECE = "file string, split bigint, place bigint, row bigint, fields map<string, string>, mz array<double>, intensity array<double>, error string, line bigint, lines bigint"
PIECE_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.int64(), pa.int64())
PIECE_NAMES = [c.split(" ")[0] for c in PIECE.replace(", string>", ",string>").split(", ")]


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """A row for each block, and a last one with `error` for a file that stops being well formed.

    Spark's text reader cuts a file before each line that begins a block, so a piece is a block and what follows it, wherever the file's splits
    are. Lines and blocks before a split, and a file's first error, are put together from a few numbers for each split.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, n, lines = None, 0, 0, 0
        for b in batches:
            out = []
            for file, split, text in zip(*(b[c].to_pylist() for c in ("file", "split", "value")), strict=True):
                if (file, split) != own:
                    own, place, n, lines = (file, split), 0, 0, 0
                listed = f"{'' if split == place == 0 else 'BEGIN IONS'}{text}\n".splitlines()
                error, line = None, None
                try:
                    for fields, mz, intensity in blocks(iter(listed)):
                        out.append((file, split, place, n, list(fields.items()), mz, intensity, None, None, None))
                        n += 1
                except MgfError as e:
                    error, line = e.message, 0 if e.line is None else lines + e.line
                lines += len(listed)
                out.append((file, split, place, n, None, [], [], error, line, lines))
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_KINDS, strict=True)], PIECE_NAMES)

    text = spark.read.text(path, lineSep="\nBEGIN IONS").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    found = text.mapInArrow(rows, PIECE)
    ends = found.filter("lines is not null").groupBy("file", "split").agg(F.max("lines").alias("lines"), F.max("row").alias("rows"), F.max("place").alias("last"), F.min(F.when(F.col("error").isNotNull(), F.struct("place", "row"))).alias("bad"))
    ahead, whole = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # a row for each split of a file
    ends = ends.select(
        "file", "split", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("lines", "rows")),
        F.min(F.when(F.col("bad").isNotNull(), F.struct("split", "bad.place", "bad.row"))).over(whole).alias("first"), F.max(F.struct("split", "last")).over(whole).alias("end"),
    )
    placed = found.join(F.broadcast(ends), ["file", "split"])
    here = F.struct("split", "place", "row")
    kept = placed.filter(F.when(F.col("lines").isNull(), F.col("first").isNull() | (here < F.col("first"))).otherwise(here == F.col("first")))
    unended = F.col("line") == 0
    at_end = F.struct("split", F.col("place").alias("last")) == F.col("end")
    line = F.col("lines_before") + F.when(unended, F.col("lines") + 1).otherwise(F.col("line"))
    message = F.when(unended & at_end, F.lit(UNENDED)).otherwise(F.format_string("line %d: %s", line, F.when(unended, F.lit(NESTED)).otherwise(F.col("error"))))
    return kept.select("file", (F.col("rows_before") + F.col("row")).cast("int").alias("n"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), "mz", "intensity", F.when(F.col("error").isNotNull(), message).alias("error"))


def library_records(records: DataFrame) -> DataFrame:
    """Records with the needed fields as columns, `problem` naming the first that is missing, repeated or not a number, and
    `peaks_differ` where num_peaks is not the number of peaks, which is noted and never trusted."""
    out = records.filter("error is null").select("file", "n", *(F.nullif(F.try_element_at("fields", F.lit(k)), F.lit("")).alias(k) for k in NEEDED), "mz", "intensity", F.try_element_at("fields", F.lit("num_peaks")).try_cast("int").alias("stated"))
    repeated = F.count("usi").over(Window.partitionBy("usi")) > 1
    missing = [F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in NEEDED]
    problem = F.coalesce(*missing, F.when(repeated, F.lit("usi repeats")), F.when(F.coalesce(F.col("precursor_mz").try_cast("double"), F.lit(0.0)) <= 0, F.lit("precursor_mz is no positive number")))
    return out.withColumn("problem", problem).withColumn("peaks_differ", F.coalesce(F.col("stated") != F.size("mz"), F.lit(False))).drop("stated")
