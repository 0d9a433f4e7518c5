"""Small documents with the awkward cases."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "and", "ra", "re", "ti"]) + rng.choice("abcdefgh") * rng.randint(0, 3) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split(" ")
    near[60] = "changed"
    out = [(1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, "b"), (5, "", None), (6, "  \n\t ", None), (7, "one two", "a"), (8, "one  two", "c"), (None, base, "c"), (9, prose(rng, 3000), "c")]
    out += [(10 + k, f"{prose(rng, 20)}\n{passage} {prose(rng, 15)}", "a") for k in range(4)]
    out += [(20, prose(rng, 50), "d"), (20, prose(rng, 50), "d"), (21, "x", "d"), (22, base, "b"), (22, base, "b"), (23, "Été à la mer — 日本 " * 9, "e")]
    return out + [(30 + k, prose(rng, rng.randint(1, 90)), rng.choice("abc")) for k in range(40)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
