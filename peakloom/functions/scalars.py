"""Scalar functions as column expressions: rounding, bands, words, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOLERANCE = 0.1


def round_mz(value: Column | str, digits: int) -> Column:
    """Half up on the scaled binary value; the same expression works in other SQL engines."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def defect(mz: Column) -> Column:
    return mz - F.floor(mz)


def tolerance(target: Column, ppm: float | None, da: float | None) -> Column:
    """ppm wins over an absolute tolerance, which wins over the default."""
    if ppm is not None:
        return F.abs(target * (ppm / 1e6))
    return F.lit(float(DEFAULT_TOLERANCE if da is None else da))


def within(value: Column, target: Column, margin: Column) -> Column:
    """The open band around target."""
    return (value > target - margin) & (value < target + margin)


def half_bin(mz: Column, ppm: float | None, da: float | None) -> Column:
    """How far a candidate m/z reaches: half the larger tolerance, 0.05 without any; tolerances of 10000 or more count as none."""
    if ppm is None and da is None:
        return F.lit(0.05)
    ppm, da = (0.0 if t is None or t >= 10000 else t for t in (ppm, da))
    return F.greatest(mz * (ppm / 1e6), F.lit(float(da))) / 2


def word(prefix: str, mz: Column, digits: int = 2) -> Column:
    return F.concat(F.lit(f"{prefix}@"), round_mz(mz, digits).cast("string"))


def fixed_word(prefix: str, mz: Column, digits: int = 2) -> Column:
    return F.concat(F.lit(f"{prefix}@"), F.format_string(f"%.{digits}f", mz))


def repetitions(weight: Column, scale: int = 100) -> Column:
    """Half to even."""
    return F.rint(weight * scale).cast("bigint")


def word_mass(text: Column) -> Column:
    """The mass of a frag@ or loss@ word, in either case; null if it is no finite number of at least 0."""
    value = F.regexp_extract(text, r"(?i)^(?:frag|loss)@([0-9]+(?:\.[0-9]*)?|\.[0-9]+)$", 1)
    return F.when(value != "", value.cast("double"))


def neutral_loss(precursor: Column, mz: Column, least: float = 0.01) -> Column:
    loss = precursor - mz
    return F.when(loss > least, loss)


def grade(overlap: Column, total: Column, correlation: Column) -> Column:
    """A to D of a screening hit by matched features, their summed motif intensities and correlation; null for none of them."""
    good = (overlap >= 3) & (total >= 0.9)
    return (
        F.when(good & (correlation >= 0.7), "A")
        .when(good & (correlation >= 0.5), "B")
        .when((overlap >= 2) & (total >= 0.5) & (correlation >= 0.3), "C")
        .when((overlap >= 2) & (total >= 0.8), "D")
    )


def quality_bin(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score > 0.8, "high").when(score > 0.6, "intermediate").otherwise("low")


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def stable_digest(seed: int, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}"), F.char(F.lit(0)), value), 256)


def natural_number(name: Column) -> Column:
    """The number inside names such as motif_12, for ordering."""
    return F.regexp_extract(name, r"(\d+)", 1).cast("bigint")


def word_feature(text: Column) -> Column:
    """(kind, value) of a word: 0 for fragments, 1 for losses, 2 for anything else; the mass on a logarithmic scale on which 2000 is 1."""
    mass = word_mass(text)
    kind = F.when(mass.isNull(), 2).when(F.lower(text).startswith("frag@"), 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.coalesce(F.log1p(mass) / F.log1p(F.lit(2000.0)), F.lit(0.0)).alias("value"))


def accuracy(digits: int) -> float:
    """Half a unit of the last digit."""
    return 10.0**-digits / 2


def document_key(words: Column) -> Column:
    """The md5 of a document's words put together."""
    return F.md5(F.array_join(words, "").cast("binary"))


def listed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ", ")


def normal_key(name: Column) -> Column:
    """A metadata key without outer blanks, in lower case."""
    return F.lower(F.trim(name))
