"""The objects of a large JSON file, read by many tasks.

Spark's text reader cuts the file at every closing brace, wherever its splits are, so a task sees its split's pieces in order. Whether a brace
is inside a string, and how deep it is, depends on everything before; but the effect of a split on both is known from the split alone, for
either state it may begin in: whether it ends inside a string, by how much the depth changes, and how deep a brace closes at least. These
few numbers a split are put together in the order of splits; then tasks know where objects end. Objects inside a split are rows at once, those that
cross splits are glued from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEVER = 1 << 30


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it follows an odd number of quotes, and its step in depth if it is outside of strings."""
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != ord("\\"), place, -1)) if len(data) else place
    before = np.concatenate([[-1], other[:-1]])[: len(data)]  # the last byte before each that is no backslash
    quotes = (data == ord('"')) & ((place - 1 - before) % 2 == 0)
    odd = (np.cumsum(quotes) - quotes) % 2 == 1
    step = np.isin(data, (ord("{"), ord("["))).astype(np.int64) - np.isin(data, (ord("}"), ord("]")))
    return odd, step


def pieces_of(b: pa.RecordBatch) -> bytes:
    """The batch's pieces with the braces that cut them."""
    return b"".join(x.encode() + b"}" for x in b["value"].to_pylist())


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the file or split changes."""
    for b in batches:
        files, splits = b["file"].dictionary_encode().indices.to_numpy(), b["split"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(splits) != 0)) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield b["file"][s].as_py(), int(splits[s]), b.slice(s, e - s)


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for beginning outside and inside a string: where it ends, by how much depth changes, and the least depth at a closing brace."""
    found: dict[tuple[str, int], list] = {}
    for file, split, b in runs(batches):
        raw = pieces_of(b)
        data = np.frombuffer(raw, np.uint8)
        odd, step = structure(data)
        quotes = bool(odd[-1]) ^ (data[-1] == ord('"'))  # the last byte is a brace
        own = found.setdefault((file, split), [raw.lstrip()[:1].decode(errors="replace"), [0, 0, NEVER], [1, 0, NEVER]])
        for state in own[1:]:
            outside = odd == bool(state[0])
            depth = state[1] + np.cumsum(np.where(outside, step, 0))
            state[2] = min(state[2], int(depth[outside & (data == ord("}"))].min(initial=NEVER)))
            state[0], state[1] = state[0] ^ int(quotes), int(depth[-1])
    for (file, split), (first, out, inside) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, split, first, *out, *inside)], NAMES)


NAMES = ["file", "split", "first", "out_string", "out_depth", "out_least", "in_string", "in_depth", "in_least"]


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the objects of an array, or those that stand beside each other, of any sizes, each file read by as many tasks as it has splits."""
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    kinds = "file string, split bigint, first string, " + ", ".join(f"{n} bigint" for n in NAMES[3:])
    starts: dict[tuple[str, int], tuple[int, int, int, int]] = {}
    file, string, depth, base, group = None, 0, 0, 0, 0
    for r in sorted(pieces.mapInArrow(effects, kinds).collect()):  # a row for each split
        if r["file"] != file:
            file, string, depth, base, group = r["file"], 0, 0, int(r["first"] == "["), r["split"]
        starts[file, r["split"]] = string, depth, base, group
        side = "in" if string else "out"
        if depth + r[f"{side}_least"] <= base:  # an object ends here, so what follows the last one begins anew
            group = r["split"] + 1
        string, depth = r[f"{side}_string"], depth + r[f"{side}_depth"]
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole objects, and the parts at a split's edges with the group they belong to."""
        out: list[tuple] = []
        own, held = None, b""
        string = depth = base = group = 0

        def close() -> None:
            if own is not None and held:
                out.append((*own, group, held.decode()))

        for file, split, b in runs(batches):
            if (file, split) != own:
                close()
                own, held = (file, split), b""
                string, depth, base, group = shared.value[own]
            raw = pieces_of(b)
            data = np.frombuffer(raw, np.uint8)
            odd, step = structure(data)
            outside = odd == bool(string)
            deep = depth + np.cumsum(np.where(outside, step, 0))
            last = 0
            for end in (np.flatnonzero(outside & (data == ord("}")) & (deep == base)) + 1).tolist():
                # the first one to end may have begun in a split before
                out.append((file, split, group if group <= split else None, (held + raw[last:end]).decode()))
                held, last, group = b"", end, split + 1
            held += raw[last:]
            string, depth = int(bool(odd[-1])) ^ string, int(deep[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "split", "part_of", "text"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "split", "part_of", "text"])

    found = pieces.mapInArrow(cut, "file string, split bigint, part_of bigint, text string")
    glued = found.filter("part_of is not null").groupBy("file", "part_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text"))
    every = found.filter("part_of is null").select("file", "text").unionByName(glued.select("file", "text"))
    return every.select("file", F.regexp_replace("text", r"^[^{]*", "").alias("text")).filter(F.col("text").rlike(r"\}\s*$"))
