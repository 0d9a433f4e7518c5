import json
import sqlite3

import pytest

from peakloom.functions import chemistry, sketches
from peakloom.operators import runs
from peakloom.sources import sinks


def test_kinds_plug_in(spark):
    chemistry.add_kind("vowels", lambda: lambda s: [s.count(v) for v in "aeiou"] if s and s.isalpha() else None)
    chemistry.add_kind("grams", lambda: lambda s: [s[k : k + 2] for k in range(len(s) - 1)] if s else None)
    df = spark.createDataFrame([(1, "banana"), (2, "7"), (3, None), (4, "")], "id int, smiles string")
    assert {r["id"]: r["print"] for r in chemistry.fingerprints(df, "vowels").collect()} == {1: [3, 0, 0, 0, 0], 2: None, 3: None, 4: None}
    assert {r["part"]: r["n"] for r in chemistry.counted(df, "grams", "id").collect()} == {"ba": 1, "an": 2, "na": 2}
    assert [r["id"] for r in chemistry.known_molecules(df, "vowels").collect()] == [1]
    maps = sketches.permutations(8)
    found = {r["id"]: r["sketch"] for r in chemistry.sketched(df, "grams", maps).collect()}
    assert len(found[1]) == 8 and chemistry.fingerprints(df.limit(0), "vowels").count() == 0
    with pytest.raises(ValueError):
        chemistry.fingerprints(df, "no such kind")


def test_kinds_of_a_missing_library_say_so(spark):
    df = spark.createDataFrame([("CCO",)], "smiles string")
    for kind in chemistry.VECTORS | chemistry.STRINGS:
        if not chemistry.available(kind):
            with pytest.raises(ImportError, match="rdkit"):
                chemistry.fingerprints(df, kind)


def test_fingerprints_where_the_library_is_there(spark):
    pytest.importorskip("rdkit")
    df = spark.createDataFrame([("c1ccccc1CCO",), ("no molecule",)], "smiles string")
    for kind, n in (("maccs", 167), ("ecfp", 1024), ("fcfp", 1024), ("atom_pairs", 2048), ("torsions", 2048), ("avalon", 512)):
        one, none = (r["print"] for r in chemistry.fingerprints(df, kind).collect())
        assert len(one) == n and any(one) and none is None
    assert chemistry.fingerprints(df.limit(1), "scaffold").first()["print"] == ["c1ccccc1"]


def test_manifests_and_reuse(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    first = runs.manifest(spark, {"topics": 3}, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert first == runs.manifest(spark, {"topics": 3}, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    (tmp_path / "b.txt").write_text("three")
    second = runs.manifest(spark, {"topics": 4}, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert runs.changed(first, second) == ["options.topics", "inputs.b.txt"] and first["key"] != second["key"]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [runs.reused(spark, str(tmp_path / "kept"), first["key"], make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_metric_rows_and_report(spark, tmp_path):
    rows = None
    for seed in (1, 2, 3):
        part = runs.metric_rows(spark.createDataFrame([(float(seed), seed * 10)], "nll double, topics int"), method="m", seed=seed)
        rows = part if rows is None else rows.unionByName(part)
    assert {(r["metric"], r["median"], r["min"], r["max"], r["n"]) for r in runs.report(rows, "method").collect()} == {("nll", 2.0, 1.0, 3.0, 3), ("topics", 20.0, 10.0, 30.0, 3)}
    runs.write_report(rows, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r" / "csv"), header=True).count() == 6 == spark.read.json(str(tmp_path / "r" / "jsonl")).count()
    prints = spark.createDataFrame([(1, 0, [1, 2]), (2, 0, [2, 3]), (1, 1, []), (2, 1, [])], "run int, topic int, print array<int>")
    assert {(r["topic"], round(r["jaccard"], 6)) for r in runs.annotation_agreement(prints).collect()} == {(0, round(1 / 3, 6)), (1, 1.0)}
    table = runs.ranked_table(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "m string, x double"), "x")
    assert [(r["m"], r["place"]) for r in table.orderBy("place").collect()] == [("c", 1), ("a", 2), ("b", 3)]


def test_shared_folders_names_and_library_joins(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert [sinks.run_folder(base, "run", spark).rpartition("/")[2] for _ in range(3)] == ["run", "run_1", "run_2"]
    sinks.write_text(spark, f"{base}/run/x.json", json.dumps({"é": 1}))
    assert json.loads((tmp_path / "run" / "x.json").read_text()) == {"é": 1}
    assert sinks.safe_path("f/short.csv") == "f/short.csv" and len(sinks.safe_path("f/" + "x" * 200).rpartition("/")[2]) == 113
    with sqlite3.connect(tmp_path / "l.db") as c:
        c.execute("create table lib (id integer, formula text, smiles text)")
        c.executemany("insert into lib values (?, ?, ?)", [(k, f"C{k % 3}", f"s{k}") for k in range(2000)])
    keys = spark.createDataFrame([(k,) for k in (5, 1500, 9999)], "k long").repartition(2)
    out = sinks.library_join(keys, "k", str(tmp_path / "l.db"), "lib", "id", "id bigint, formula string, smiles string")
    assert sorted((r["k"], r["smiles"]) for r in out.collect()) == [(5, "s5"), (1500, "s1500")]
    by_formula = sinks.library_join(spark.createDataFrame([("C1",), ("X",)], "f string"), "f", str(tmp_path / "l.db"), "lib", "formula", "id bigint, formula string, smiles string")
    assert by_formula.count() == 667
    sinks.results_table(spark.createDataFrame([("7", 1.0)], "scan string, comment double"), str(tmp_path / "t"), filename="/x/y.mzML", original_path="z/y.mzML")
    r = spark.read.csv(str(tmp_path / "t"), header=True).first()
    assert (r["filename"], r["original_path"]) == ("y.mzML", "z/y.mzML")


def manifest_of(inputs=None, **options):
    body = {"options": options, "inputs": inputs or {"a": "1"}}
    return body | {"key": runs.body_key(body)}


def test_derivations_are_permitted_or_refused():
    old = manifest_of(name="x", iterations=20, topics=5, threads=1, inspected=False, timing="before")
    make = lambda **change: manifest_of(**(old["options"] | change))
    more = runs.derived(old, make(iterations=40), "continuation", " not converged ")
    assert more["derivation"] == {"from": old["key"], "kind": "continuation", "reason": "not converged"} and more["key"] == runs.body_key(more)
    assert runs.derived(more, make(iterations=60), "continuation", "again")["derivation"]["from"] == more["key"]
    assert runs.refused(old, make(threads=4, name="y"), "execution", "faster") == []
    assert runs.refused(old, make(inspected=True, timing="after"), "correction", "a fault") == []
    for change, kind, reason, why in [
        ({"iterations": 40, "topics": 6}, "continuation", "r", ["changes topics"]), ({"iterations": 10}, "continuation", "r", ["does not raise iterations"]),
        ({}, "continuation", "r", ["keeps iterations"]), ({"iterations": 40}, "continuation", "  ", ["reason"]), ({"threads": 2}, "evaluation", "r", ["changes threads", "keeps name"]),
        ({"name": "y"}, "fancy", "r", ["kind"]), ({"inspected": True}, "correction", "r", ["keeps timing"]),
    ]:
        assert runs.refused(old, make(**change), kind, reason) == why
        with pytest.raises(ValueError, match=why[0]):
            runs.derived(old, make(**change), kind, reason)
    assert runs.refused(old, manifest_of({"a": "2"}, **(old["options"] | {"iterations": 30})), "continuation", "r") == ["inputs"]
    assert runs.refused(old | {"options": old["options"] | {"topics": 9}}, make(iterations=30), "continuation", "r") == ["changes topics", "earlier key"]
    assert not runs.RULES["correction"].reuses & {"model"}


def test_lineages_of_many_runs(spark):
    rows = [("a", None, None, None, {"iterations": "5", "topics": "3"})]
    rows += [(f"c{k}", f"c{k - 1}" if k else "a", "continuation", "more", {"iterations": str(6 + k), "topics": "3"}) for k in range(20)]
    rows += [("lost", "gone", "execution", "r", {}), ("after", "lost", "execution", "r", {"name": "n"}), ("x", "y", "execution", "r", {}), ("y", "z", "execution", "r", {}), ("z", "x", "execution", "r", {}), ("on", "x", "execution", "r", {})]
    rows += [("low", "a", "continuation", "", {"iterations": "4", "topics": "4"}), ("odd", "a", "none", "r", {"iterations": "5", "topics": "3"}), ("same", "a", "continuation", "r", {"iterations": "5", "topics": "3"})]
    df = spark.createDataFrame(rows, "key string, source string, kind string, reason string, options map<string,string>")
    got = {}
    for r in runs.lineage_faults(df).collect():
        got.setdefault(r["key"], []).append(r["fault"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "lost": ["no source"], "low": ["changes topics", "does not raise iterations", "reason"], "odd": ["kind"], "same": ["keeps iterations"],
        **{k: ["no origin"] for k in ("x", "y", "z", "on")},
    }
    assert runs.lineage_faults(df.limit(1)).count() == 0 == runs.lineage_faults(df.limit(0)).count()
