"""Spectra cleaning, word corpora, vocabularies and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import neutral_loss, repetitions, stable_digest, word


def clean(peaks: DataFrame, low_mz: float = 0.0, high_mz: float = 1000.0, low: float = 0.001, high: float = 1.0, top: int = 500, least: int = 3) -> DataFrame:
    """Peaks normalised to the scan's maximum, inside inclusive bands, the `top` most intense, of scans that keep `least`."""
    scan = Window.partitionBy("scan")
    out = peaks.filter("frag_mz > 0 and frag_intens >= 0 and not isnan(frag_mz) and not isnan(frag_intens)")
    out = out.withColumn("w", F.col("frag_intens") / F.max("frag_intens").over(scan))
    out = out.filter(F.col("frag_mz").between(low_mz, high_mz) & F.col("w").between(low, high))
    ranked = out.withColumn("rank", F.row_number().over(scan.orderBy(F.desc("w"), "frag_mz", "loss_mz")))
    return ranked.filter(F.col("rank") <= top).withColumn("n_peaks", F.count("*").over(scan)).filter(F.col("n_peaks") >= least)


def strict_clean(peaks: DataFrame, low_mz: float = 0.0, high_mz: float = 1000.0, low: float = 0.001, high: float = 1.0, top: int = 500, least: int = 3) -> DataFrame:
    """As `clean`, but a peak that is not finite, has no positive m/z or a negative intensity is an error; peaks are numbered by m/z.

    peaks (scan, peak_idx, frag_mz, frag_intens); of equally intense peaks the earlier ones stay.
    """
    scan = Window.partitionBy("scan")
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = sound("frag_mz") & sound("frag_intens") & (F.col("frag_mz") > 0) & (F.col("frag_intens") >= 0)
    checked = peaks.withColumn("frag_mz", F.when(fine, F.col("frag_mz")).otherwise(F.raise_error(F.concat(F.lit("unsound peak in scan "), "scan")).cast("double")))
    out = checked.withColumn("w", F.col("frag_intens") / F.max("frag_intens").over(scan))
    out = out.filter(F.col("frag_mz").between(low_mz, high_mz) & F.col("w").between(low, high))
    ranked = out.withColumn("_rank", F.row_number().over(scan.orderBy(F.desc("w"), "peak_idx"))).filter(F.col("_rank") <= top).drop("_rank")
    several = ranked.withColumn("n_peaks", F.count("*").over(scan)).filter(F.col("n_peaks") >= least)
    return several.withColumn("peak_idx", F.row_number().over(scan.orderBy("frag_mz", "peak_idx")))


def words(peaks: DataFrame, digits: int = 2, losses: bool = False, parts: int | None = None) -> DataFrame:
    """(scan, word, n): a fragment's word as often as a hundred times its relative intensity; losses take their own peak's.

    parts: how many parts the scans are dealt into, which bounds a task's sorts and counts; else the session's shuffle partitions.
    """
    scan = Window.partitionBy("scan")
    if parts:
        peaks = peaks.select("scan", "frag_mz", "frag_intens", *(["precmz"] if losses else [])).repartition(parts, "scan")
    weighed = peaks.withColumn("w", F.col("frag_intens") / F.max("frag_intens").over(scan)).withColumn("n", repetitions(F.col("w")))
    kinds = [F.struct(word("frag", F.col("frag_mz"), digits).alias("word"))]
    if losses:
        loss = neutral_loss(F.col("precmz"), F.col("frag_mz"))
        kinds.append(F.struct(F.when(loss.isNotNull(), word("loss", loss, digits)).alias("word")))
    out = weighed.select("scan", "n", F.explode(F.array(*kinds)).alias("k")).select("scan", "n", "k.word")
    return out.filter("n > 0 and word is not null").groupBy("scan", "word").agg(F.sum("n").alias("n"))


def vocabulary(corpus: DataFrame, min_cf: int = 1, min_df: int = 1, drop_top: int = 0) -> DataFrame:
    """(word, cf, df) of the words frequent enough, without the drop_top most frequent, ties by word."""
    counts = corpus.groupBy("word").agg(F.sum("n").alias("cf"), F.countDistinct("scan").alias("df")).filter((F.col("cf") >= min_cf) & (F.col("df") >= min_df))
    if not drop_top:
        return counts
    top = counts.orderBy(F.desc("cf"), "word").limit(drop_top)
    return counts.join(F.broadcast(top.select("word")), "word", "left_anti")


def completion_split(peaks: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """peaks with `observed`: the first round(share * n) of a scan by digest, at least one and not all; a scan of one peak is an error."""
    scan = Window.partitionBy("scan")
    n = F.count("*").over(scan)
    first = F.greatest(F.least(F.rint(n * share), n - 1), F.lit(1))
    key = stable_digest(seed, F.concat("scan", F.char(F.lit(0)), F.col("peak_idx").cast("string")))
    few = F.raise_error(F.concat(F.lit("completion needs two peaks of scan "), "scan"))
    return peaks.withColumn("observed", F.when(n < 2, few.cast("boolean")).otherwise(F.row_number().over(scan.orderBy(key)) <= first))


def renormalised(observed: DataFrame, digits: int = 2) -> DataFrame:
    """(scan, peak_idx, w, n, word, loss): observed peaks by their own maximum, with at least one repetition; loss words only above 0.01."""
    w = F.col("frag_intens") / F.max("frag_intens").over(Window.partitionBy("scan"))
    loss = neutral_loss(F.col("precmz"), F.col("frag_mz"))
    return observed.withColumn("w", w).select("scan", "peak_idx", "w", F.greatest(repetitions(F.col("w")), F.lit(1)).alias("n"), word("frag", F.col("frag_mz"), digits).alias("word"), F.when(loss.isNotNull(), word("loss", loss, digits)).alias("loss"))


def limited(peaks: DataFrame, least: float = 1.0, top: int = 1000) -> DataFrame:
    """Peaks (scan, mz, i) with m/z and intensity of at least `least`, and of MS2 scans the `top` most intense; ms_level where there is one."""
    kept = peaks.filter((F.col("mz") >= least) & (F.col("i") >= least))
    rank = F.row_number().over(Window.partitionBy("scan").orderBy(F.desc("i"), F.desc("mz")))
    ms2 = F.col("ms_level") == 2 if "ms_level" in peaks.columns else F.lit(True)
    return kept.withColumn("_rank", rank).filter(~ms2 | (F.col("_rank") <= top)).drop("_rank")


def previous_ms1(scans: DataFrame) -> DataFrame:
    """scans (file, n, ms_level, scan) with ms1scan, the last MS1 scan before."""
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return scans.withColumn("ms1scan", F.last(F.when(F.col("ms_level") == 1, F.col("scan")), True).over(before))
