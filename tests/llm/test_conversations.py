"""Conversation repair against a search over all edits, and the two ways of a conversation against each other and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from peakloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Cheapest first, then ASCII-least, over all edit sequences; rows are (role, text, fault)."""
    todo = [(0, "", 0, "", ())]
    most = len(rows) + 3
    while todo:
        cost, letters, k, roles, turns = heapq.heappop(todo)
        if k == len(rows) and LEGAL.fullmatch(roles):
            return cost, letters, "\n".join(turns)
        prefix = "s" * roles.startswith("s") + "ua" * most
        if not prefix.startswith(roles):
            continue
        for name in ("user", "assistant"):
            if len(roles) < most + 2:
                heapq.heappush(todo, (cost + 3, letters + "I", k, roles + name[0], (*turns, f"{name}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(todo, (cost + 4, letters + "D", k + 1, roles, turns))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                heapq.heappush(todo, (cost + extra, letters + "K", k + 1, roles + (role[:1] or "-"), (*turns, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(todo, (cost + 3 + extra, letters + "R", k + 1, roles + name[0], (*turns, f"{name}:{text}")))
    raise AssertionError


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def expected(rows):
    """The contract's columns by search, of (turn, role, text) in order."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, letters, text = search([(r, t, f) for (_, r, t), f in zip(rows, found, strict=True)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())


def made(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", "d?  ", "e\n", " \t", "", "f\xa0", "g"])) for _ in range(n)]


def test_audits_by_search():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(k, *x) for k, x in enumerate(made(rng, rng.randint(0, 5)))]
        assert C.repaired(rows) == expected(rows), rows
    assert C.before.cache_info().currsize < 2000  # costs to go take few values


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([t, t, t, t + 3, None]), *x) for c in range(120) for t, x in enumerate(made(rng, rng.randint(1, 6)))]
    rows += [(None, t, "user", f"q{t}?") for t in range(5)] + [(None, None, None, None), (None, None, "user", None)]
    rows += [(500, t, "user" if t % 2 else "assistant", f"t{t % 90}" + ".!?x"[t % 4]) for t in range(400)] + [(600, 1, "user", "same.")] * 150
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.mark.parametrize("hold", [10_000, 3, 0])
def test_repair_by_brute_force(table, hold, monkeypatch):
    monkeypatch.setattr(C, "HOLD_ROWS", hold)
    df, rows = table
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by_conv.keys()
    for c, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
        assert got[c] == (expected(own) if len(own) < 9 else C.repaired(own)), c


def test_long_conversations_lie_in_many_parts(spark, table):
    rows = [(7, t, "user" if t % 2 else "assistant", f"turn {t % 700}" + (" ends." if t % 5 else "")) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    parts = df.repartitionByRange(4, *order).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == 4
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (got,) = C.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert tuple(got) == (7, *C.repaired([r[1:] for r in rows]))
    assert got["duplicate"] == 2300 and len(got["audit"]) >= 3000


def test_damage_and_sql(spark, table, duck):
    import duckdb

    df, rows = table
    out = C.damaged(df).filter("live").collect()
    by_kind = {k: 0 for k in range(5)}
    for c, t, _, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        by_kind[kind] = by_kind.get(kind, 0) + 1
    assert len(out) == len(rows) - by_kind[0] + by_kind[3]
    own = duckdb.connect()
    own.register("conversations", df.toArrow())
    want = {r[0]: r[1:] for r in own.execute(C.OP13_SQL).fetchall()}
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damaged(df), live=F.col("live")).collect()}
    assert got == want


def test_nothing_and_odd_columns(spark, table):
    df, _ = table
    assert C.repair(df.limit(0)).count() == 0 and C.repair(df.limit(0)).columns == ["conv_id", *C.RESULT]
    gone = C.repair(df, live=F.lit(False)).collect()
    empty = hashlib.sha256().hexdigest()
    assert len(gone) == 123 and {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", empty)}
    odd = spark.createDataFrame([(1, 0, "user", "hi.", 5, "z"), (1, 1, "assistant", "yes. " * 40_000, 6, "z")], SCHEMA + ", code int, audit string")
    (got,) = C.repair(odd).collect()
    assert got["audit"] == "KK" and got["cost"] == 0
