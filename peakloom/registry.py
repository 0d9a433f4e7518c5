"""The registry of queries, each beside SQL that computes the same, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.adapters import MS1_SQL, MS2_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PEAKS = f"with ms2 as ({MS2_SQL}), ms1 as ({MS1_SQL})"
THETA = "with cells as (select vec_id as id, unnest(range(64))::int as topic, abs(unnest(embedding)::double) as e from embeddings), theta as (select id as doc, topic, e / sum(e) over (partition by id) as p from cells), beta as (select topic, id as word, e / sum(e) over (partition by topic) as p from cells)"


def r6(c: Column | str) -> Column:
    """Rounded alike in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def q6(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.5e0) / 1e6"


def named(name: str) -> str:
    return f"{q6(name)} as {name}"


def register(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep
