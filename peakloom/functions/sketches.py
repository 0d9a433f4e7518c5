"""MinHash sketches of string sets, and fingerprints folded from them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def permutations(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """n pairs (a, b) of the maps h -> (a * h + b) mod PRIME."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def shingle_hash(text: Column) -> Column:
    """The first four bytes of SHA-1, modulo PRIME, so that products stay within 64 bits."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def lingo(text: Column, n: int = 4) -> Column:
    """The distinct substrings of n characters; shorter texts have none."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))))


def minhash(shingles: Column, maps: list[tuple[int, int]]) -> Column:
    """For each map the least hash of a shingle; PRIME where there is none."""
    hashes = F.transform(shingles, shingle_hash)
    each = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in maps])
    least = lambda m: F.coalesce(F.array_min(F.transform(hashes, lambda h: (m["a"] * h + m["b"]) % F.lit(PRIME))), F.lit(PRIME).cast("bigint"))
    return F.transform(each, least)


def distance(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - same / F.size(a)


def merged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def folded(shingles: Column, length: int) -> Column:
    """The positions that hashes set in a fingerprint of that length, ascending."""
    return F.array_sort(F.array_distinct(F.transform(shingles, lambda s: shingle_hash(s) % F.lit(length))))


def merged_all(sketches: DataFrame, key: str, column: str) -> DataFrame:
    """(key, sketch): the sketch of all sets of a key together, the least value at each position."""
    cells = sketches.select(key, F.posexplode(column).alias("_pos", "_value")).groupBy(key, "_pos").agg(F.min("_value").alias("_value"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda x: x["_value"]).alias(column))
