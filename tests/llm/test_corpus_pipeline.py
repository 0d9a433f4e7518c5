import collections
import re
import zlib

import numpy as np

import corpus_pipeline
from peakloom.llm import decontaminate, jaccard, mixing, quality
from peakloom.llm.common import settle
from peakloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = settle(stage(spark, kept, DATA), name)
        assert after.columns == docs.columns and after.count() <= kept.count(), name
        kept = after
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    junk = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 0").collect()}
    assert junk and not ids & junk
    assert jaccard.links(kept).filter("n_links > 0").count() == 0
    assert decontaminate.leaks(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    mix = mixing.resample(kept).collect()
    assert {r["doc_id"] for r in mix} <= ids


def test_stages_on_awkward_documents(spark, docs, texts, nothing):
    """Nulls, repeats, ties, empty tables and clashing columns, stage by stage, against brute force where it is short."""
    from pyspark.sql import functions as F

    extra = {name: F.lit(7) for name in ("score", "predicted", "copies", "twin", "item_id", "node", "similarity")} | {"m": F.create_map(F.lit("a"), F.lit(1))}
    given = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        empty = stage(spark, nothing.withColumns(extra), DATA)
        assert empty.columns == given.columns and empty.count() == 0, name
        after = stage(spark, given, DATA)
        assert after.columns == given.columns, name
        rows = [(r["doc_id"], r["text"], r["source"]) for r in after.collect()]
        assert set(rows) <= set(texts) and all(r["score"] == 7 and r["m"] == {"a": 1} for r in after.collect()), name
        if name == "decontamination":
            assert sorted(rows, key=repr) == sorted(texts, key=repr)  # none of these holds a benchmark passage
        if name == "near-duplicates":
            assert {4, 5, 6} <= {i for i, _, _ in rows} and sum(i is None for i, _, _ in rows) == 1
    out = corpus_pipeline.encoded(spark, given, DATA)
    assert out.count() == len(texts) and corpus_pipeline.encoded(spark, nothing, DATA).count() == 0


def test_first_three_stages_by_brute_force(spark):
    """What is kept of a small table is what the definitions keep."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    kept = {i: t for i, t in rows.items() if scores[i] >= 0.7}
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w, n=5: [tuple(w[k : k + min(n, len(w))]) for k in range(max(len(w) - n + 1, min(len(w), 1)))]
    sets = {i: set(grams(lower(t))) for i, t in kept.items()}
    root = {i: i for i in kept}
    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {x: low if r == high else r for x, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    items = [lower(r["text"] or "") for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for item in filter(None, items):
        counts = collections.Counter(grams(item))
        for i, t in list(kept.items()):
            w = lower(t)
            for at in range(max(len(w) - len(item), 0) + 1):
                window = w[at : at + len(item)]
                if len(window) >= 5 and window[0:1] and len(set(window) & set(item)) > 2:
                    own = collections.Counter(grams(window))
                    least = (own & counts).total()
                    if least >= 0.8 * (own.total() + counts.total() - least):
                        del kept[i]
                        break
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = settle(stage(spark, docs, DATA), name)
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(kept)


def test_run(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: r["start"])
    assert out and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    start = 0
    for r in out:
        ids = np.array([*t.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query_equals_sql(spark, duck):
    for name, sql in ORACLES.items():
        expected = duck.execute(sql).to_arrow_table()
        names = sorted(expected.column_names)
        got = QUERIES[name](spark, DATA).select(*names).collect()
        assert sorted(map(tuple, got)) == sorted(zip(*[expected[n].to_pylist() for n in names], strict=True))
