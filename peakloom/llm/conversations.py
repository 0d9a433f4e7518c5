"""Structure repair of conversations: the cheapest edits that make the turns' roles an optional system turn and then pairs of user and
assistant, `(s?(ua)+)?` in the roles' initials.

Each row is kept, given another role, or deleted, and empty rows can be put in anywhere. Costs to go are computed backward over rows and
the four states of the grammar; then a forward walk takes, of all edits on a cheapest way, the one with the ASCII-least initial, and the
turns are rebuilt along it. Costs to go less their minimum take few values, so each step of either pass is looked up.

A conversation may hold any share of all rows. Rows are dealt by range of conversation and turn, so a long one lies in several
partitions, of which each is read as a stream:

1. a conversation between the first and the last of its partition is whole there and repaired there, at once;
2. those at the edges, and any of more than HOLD_ROWS rows or HOLD_BYTES, are handed on by row. First occurrences of (role, text) are found with
   partial aggregation; then one byte a row, the row's fault and role, comes together by conversation, and gives the audit, which
   has as many bytes itself;
3. their rows, sorted, stream past the audit for the hash of the repaired turns. SHA-256 takes one byte after the other, so one task
   reads all of a conversation here, a batch at a time.

Faults: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no
white space ends no sentence); the first that holds counts. Blank and duplicate rows must go (deletion costs 4); a truncated row that
stays costs 3, as do a new role and a row put in.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by role, then text, as UTF-8 bytes;
rows without a conversation's id are one conversation; repeated rows are duplicates; an empty text is blank; a conversation without rows that
live has zeros, an empty audit and the empty string's hash; an empty table gives an empty result; other columns are not read, whatever
their names. Of a long text only a batch is held; equal texts of rows handed on are told by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, settle, tune

SPACES = " \t\n\v\f\r"
KEEP, ROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: States: nothing yet; after the system's turn; after the user's; after the assistant's. The role each expects, and the state that follows.
EXPECTED = (USER, USER, ASSISTANT, USER)
AFTER = (2, 2, 3, 2)
NAMES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
HOLD_ROWS, HOLD_BYTES = 10_000, 8 << 20
Costs = tuple[int, int, int, int]


def code(role: str, text: str) -> int:
    """A row's role and fault in one number; whether it is a duplicate is not known here."""
    initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
    last = text.rstrip(SPACES)[-1:]
    return initial + 4 * (BLANK if not last else SOUND if last in ".!?" else TRUNCATED)


def kept_to(state: int, role: int) -> int | None:
    """The state after a row of this role is kept, None where the grammar has no such turn."""
    if role == EXPECTED[state]:
        return AFTER[state]
    return 1 if state == 0 and role == SYSTEM else None


@lru_cache(maxsize=None)
def before(row: int, after: Costs) -> tuple[Costs, int]:
    """Costs to go before a row from those behind it, less their minimum, and that minimum."""
    role, fault = row % 4, row // 4
    out = [DELETE + c for c in after]
    if fault < DUPLICATE:
        extra = CUT if fault == TRUNCATED else 0
        for state in range(4):
            out[state] = min(out[state], ROLE + extra + after[AFTER[state]])
            if (to := kept_to(state, role)) is not None:
                out[state] = min(out[state], KEEP + extra + after[to])
    for _ in range(3):
        out = [min(c, INSERT + out[AFTER[state]]) for state, c in enumerate(out)]
    return tuple(c - min(out) for c in out), min(out)


@lru_cache(maxsize=None)
def edits(row: int, after: Costs, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from `state` up to and with this row, and the state behind them."""
    role, fault = row % 4, row // 4
    costs, least = before(row, after)
    letters = ""
    while True:
        left = costs[state] + least
        if left == DELETE + after[state]:
            return letters + "D", state
        if left == INSERT + costs[AFTER[state]] + least:
            letters, state = letters + "I", AFTER[state]
            continue
        to = kept_to(state, role)
        if to is not None and left == KEEP + (CUT if fault == TRUNCATED else 0) + after[to]:
            return letters + "K", to
        return letters + "R", AFTER[state]


def audit(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation's rows and the initials of its edits."""
    after, costs, total = END, [END], 0
    for row in reversed(codes):
        after, least = before(row, after)
        costs.append(after)
        total += least
    total += after[0]
    state, letters = 0, []
    for k, row in enumerate(codes):
        done, state = edits(row, costs[len(codes) - 1 - k], state)
        letters.append(done)
    return total, "".join(letters) + "I" * (END[state] // INSERT)


class Rebuilt:
    """The hash of a conversation's turns as they come out of its edits, row after row."""

    def __init__(self, letters: str) -> None:
        self.letters, self.state, self.sha, self.empty = iter(letters), 0, hashlib.sha256(), True

    def put(self, role: str | None, text: str) -> None:
        """A turn, of the role that the grammar expects where none is given."""
        if role is None:
            role, self.state = NAMES[EXPECTED[self.state]], AFTER[self.state]
        else:
            self.state = 1 if role[:1] == "s" else AFTER[self.state]
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self.put(None, "")
                continue
            if letter != "D":
                self.put(role if letter == "K" else None, text)
            break

    def close(self) -> str:
        for _ in self.letters:
            self.put(None, "")
        return self.sha.hexdigest()


def tallies(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles do not follow each other."""
    faults, legal = [c // 4 for c in codes], {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    illegal = sum((a % 4, b % 4) not in legal for a, b in zip(codes, codes[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of a conversation's (turn, role, text), in order."""
    seen, codes = set(), bytearray()
    for _, role, text in rows:
        own = code(role, text)
        if own // 4 != BLANK:
            if (role, text) in seen:
                own = own % 4 + 4 * DUPLICATE
            seen.add((role, text))
        codes.append(own)
    turns = {t for t, _, _ in rows if t is not None}
    cost, letters = audit(bytes(codes))
    out = Rebuilt(letters)
    for _, role, text in rows:
        out.row(role, text)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *tallies(bytes(codes)), cost, letters, out.close())


RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
ROW = {"part": pa.int32(), "pos": pa.int64(), "role": pa.string(), "text": pa.string(), "turn": pa.int64(), "code": pa.int8()}
JUDGED = [n for n in RESULT if n not in ("gaps", "repaired_sha256")]
FIRST = pa.schema({"conv_id": pa.int64(), "whole": pa.bool_(), **RESULT, **ROW})
SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.int8(): "tinyint", pa.string(): "string", pa.bool_(): "boolean"}


def ddl(*names: str) -> str:
    return ", ".join(f"{n} {SQL_TYPES[FIRST.field(n).type]}" for n in names)


def batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, FIRST.field(n).type) for c, n in zip(zip(*rows, strict=True), names, strict=True)], list(names))


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's sorted rows (conv_id, turn, role, text, live): a result for each conversation known to be whole, and the rows of the others."""
    part, pos = TaskContext.get().partitionId(), 0
    out: list[tuple] = []
    held: list[tuple] = []  # rows of the conversation that is being read
    key, handed_on, size, started = None, True, 0, False

    def hand_on() -> None:
        nonlocal pos
        for turn, role, text, live in held:
            out.append((key, False, *[None] * len(RESULT), part, pos, role, text, turn, code(role, text) if live else None))
            pos += 1
        held.clear()

    for b in batches:
        for conv, turn, role, text, live in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not started or conv != key:
                if not handed_on:
                    out.append((key, True, *repaired([r[:3] for r in held if r[3]]), *[None] * len(ROW)))
                    held.clear()
                key, handed_on, size, started = conv, not started, 0, True  # the first one may have begun in the partition before
            held.append((turn, role, text, live))
            size += len(text)
            if handed_on or len(held) > HOLD_ROWS or size > HOLD_BYTES:
                handed_on = True
                hand_on()
        if out:
            yield batch(out, *FIRST.names)
            out.clear()
    hand_on()  # the last one may go on in the next partition
    if out:
        yield batch(out, *FIRST.names)


def across_parts(rows: DataFrame) -> DataFrame:
    """The results of conversations whose rows were handed on: rows of conv_id and ROW, code null for a row that is gone."""
    live = rows.filter("code is not null")
    firsts = live.filter(F.col("code") < 4 * BLANK).groupBy("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("its")).agg(F.min(F.struct("part", "pos")).alias("at"))
    marks = live.select("conv_id", "part", "pos", "code").unionByName(firsts.select("conv_id", "at.part", "at.pos", F.lit(None).cast("tinyint").alias("code")))
    is_row = F.col("code").isNotNull()
    # what of one conversation lies in one partition of the first pass
    parts = marks.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.when(is_row, F.struct("pos", "code")))).alias("codes"),
        F.collect_list(F.when(~is_row, F.col("pos"))).alias("firsts"),
    )

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Duplicates marked; one byte a row."""
        for b in batches:
            found = []
            for k in range(len(b)):
                codes = b["codes"][k].values
                own = codes.field("code").to_numpy().copy()
                later = (own < 4 * BLANK) & ~np.isin(codes.field("pos").to_numpy(), b["firsts"][k].values.to_numpy())
                own[later] = own[later] % 4 + 4 * DUPLICATE
                found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], pa.array(found, pa.binary())], ["conv_id", "part", "codes"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for conv, pieces in zip(b["conv_id"].to_pylist(), b["pieces"].to_pylist(), strict=True):
                codes = b"".join(p["codes"] for p in sorted(pieces, key=lambda p: p["part"]))
                found.append((conv, *tallies(codes), *audit(codes)))
            yield batch(found, "conv_id", *JUDGED)

    pieces = parts.mapInArrow(told, "conv_id bigint, part int, codes binary").groupBy("conv_id").agg(F.collect_list(F.struct("part", "codes")).alias("pieces"))
    audits = settle(pieces.mapInArrow(judged, ddl("conv_id", *JUDGED)), "repair-audits")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, each conversation's audit, as a text of part -1, before them."""
        key, own = None, None
        for b in batches:
            found = []
            for conv, part, role, text in zip(*(b[n].to_pylist() for n in ("conv_id", "part", "role", "text")), strict=True):
                if part < 0:
                    if own is not None:
                        found.append((key, own.close()))
                    key, own = conv, Rebuilt(text)
                else:
                    own.row(role, text)
            if found:
                yield batch(found, "conv_id", "repaired_sha256")
        if own is not None:
            yield batch([(key, own.close())], "conv_id", "repaired_sha256")

    heads = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = live.select("conv_id", "part", "pos", "role", "text").unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    gaps = rows.groupBy("conv_id").agg(F.max(F.when(F.col("code").isNotNull(), F.col("turn"))).alias("high"), F.min(F.when(F.col("code").isNotNull(), F.col("turn"))).alias("low"), F.countDistinct(F.when(F.col("code").isNotNull(), F.col("turn"))).alias("n"))
    gaps = gaps.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    # one row of each of the three, or of the first alone where no row lives: brought together by conversation, null ids too
    found = gaps.unionByName(audits, True).unionByName(stream.mapInArrow(hashed, ddl("conv_id", "repaired_sha256")), True)
    rest = {n: F.lit(0) for n in JUDGED} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return found.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *(F.coalesce(F.max(n), default).alias(n) for n, default in rest.items())).select("conv_id", *RESULT)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    live: which rows there are; a conversation whose rows are all gone has a result too.
    """
    there = F.lit(True) if live is None else live
    rows = conversations.select(
        quoted(conv).cast("long").alias("conv_id"),
        quoted(turn).cast("long").alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit(" ")).alias("text"),
        there.alias("live"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    # the range's bounds are sampled to the driver: heads of texts, which sort as the texts do
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, "text")
    found = settle(dealt.mapInArrow(first_pass, ddl(*FIRST.names)), "repair-first")
    return found.filter("whole").select("conv_id", *RESULT).unionByName(across_parts(found.filter("not whole").select("conv_id", *ROW)))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of conv_id:turn: rows (conv_id, turn, role, text, live)."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.coalesce("text", F.lit(" ")))
    out = conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("live"), (kind == 3).alias("twice"))
    return out.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows, live=F.col("live"))


def _grown(state: str, cost: str, letter: str, turn: str = "") -> str:
    out = f"{state}.o || case when {state}.o = '' then '' else chr(10) end || {turn}" if turn else f"{state}.o"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}} end"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _op13_sql() -> str:
    """Forward over rows: for each state the least (cost, audit, turns); ties at one state and row differ before either audit ends."""
    may = lambda x: f"case when not must then {x} end"  # noqa: E731
    keep = lambda state, role: f"case when not must and initial = '{role}' then {_grown(state, 'extra', 'K', 'turn_text')} end"  # noqa: E731
    change = lambda state, name: may(_grown(state, "(3 + extra)", "R", f"'{name}:' || text"))  # noqa: E731
    row = [
        _grown("p0", "4", "D"),
        _least(_grown("p1", "4", "D"), keep("p0", "s")),
        _least(_grown("p2", "4", "D"), *(f(s) for s in ("p0", "p1", "p3") for f in (lambda s: keep(s, "u"), lambda s: change(s, "user")))),
        _least(_grown("p3", "4", "D"), keep("p2", "a"), change("p2", "assistant")),
    ]
    user = ", ".join(_grown(s, "3", "I", "'user:'") for s in ("q0", "q1", "q3"))
    return rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
kinds as (
  select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda c: ascii(c)::ubigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, bit: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)), 4294967295::ubigint) % 20 as kind from keyed),
rows as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from kinds where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role[1:1] as initial, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) as ending from rows),
faults as (
  select *, ending = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, ending not in ('', '.', '!', '?') as cut,
    lag(initial) over (partition by conv_id order by i) as ahead from placed),
tallied as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
    count(*) filter (cut and not again) as truncated, count(*) filter (ahead is not null and ahead || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faults group by conv_id),
steps as (select conv_id, i, blank or again as must, case when cut then 3 else 0 end as extra, initial, text, role || ':' || text as turn_text from faults),
walk as (
  select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 'o': ''}} as p0, null::struct(c integer, a varchar, o varchar) as p1,
    {{'c': 3, 'a': 'I', 'o': 'user:'}} as p2, {{'c': 6, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'}} as p3 from (select distinct conv_id from conversations)
  union all
  select conv_id, i, q0, q1, r2, {_least("q3", _grown("r2", "3", "I", "'assistant:'"))} from (
    select conv_id, i, q0, q1, q3, {_least("q2", user)} as r2 from (
      select w.conv_id, s.i, {", ".join(f"{x} as q{k}" for k, x in enumerate(row))} from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1))),
last as (select conv_id, {_least("p0", "p3")} as best from walk qualify row_number() over (partition by conv_id order by i desc) = 1)
select l.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit, sha256(best.o) as repaired_sha256
from last l left join tallied t on t.conv_id is not distinct from l.conv_id
"""


OP13_SQL = _op13_sql()
