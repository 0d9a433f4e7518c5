import base64
import json
import sqlite3

import numpy as np
import pytest

from peakloom.__main__ import main, merged
from peakloom.operators import checkpoints, lda, network
from peakloom.plans.describe import bands, describe
from peakloom.sources import readers, sinks, strict

MGF = "BEGIN IONS\nSCANS=7\nPEPMASS=350.5\n100.0 0.5\n150.25 1\n120 0.6\n140 0.7\n160 0.8\nEND IONS\n"


def test_motif_stores(spark, tmp_path):
    (tmp_path / "m.m2m").write_text("#NAME motif_1\n#ANNOTATION sugar\nfragment_100.123,0.5\nloss_18.01,0.25\n")
    rows = readers.read_m2m(spark, str(tmp_path / "m.m2m"))
    cells = lambda df: sorted(map(repr, df.select("motif_id", "annotation", "peak_idx", "frag_mz", "frag_intens", "loss_mz", "loss_intens").collect()))
    sinks.write_m2m(rows, str(tmp_path / "text"))
    assert cells(readers.read_m2m(spark, str(tmp_path / "text" / "motif_id=motif_1"))) == cells(rows)
    sinks.write_motifs(rows, str(tmp_path / "json"))
    assert cells(sinks.read_motifs(spark, str(tmp_path / "json"))) == cells(rows)


def test_extracted_scans_to_mzml(spark, tmp_path):
    peaks = spark.createDataFrame([("f", "10", 200.0, 1.0), ("f", "10", 100.0, 2.0), ("f", "9", 50.0, 3.0), ("f", "8", 1.0, 1.0)], "file string, scan string, frag_mz double, frag_intens double")
    results = spark.createDataFrame([("f", "10", 300.5), ("f", "9", None), ("f", "9", None)], "file string, scan string, precmz double")
    out = sinks.extracted(peaks, results)
    assert [(r["scan"], r["new_scan"], [p["mz"] for p in r["peaks"]]) for r in out.orderBy("new_scan").collect()] == [("9", 1, [50.0]), ("10", 2, [100.0, 200.0])]
    sinks.write_mzml(out.coalesce(1), str(tmp_path / "o.mzml"))
    found = sorted((r["scan"], r["mz"], r["i"], r["precmz"]) for r in readers.read_raw(spark, str(tmp_path / "o.mzml")).collect())
    assert found == [("1", 50.0, 3.0, None), ("2", 100.0, 2.0, 300.5), ("2", 200.0, 1.0, 300.5)]
    assert sinks.extracted(peaks, results, 1).count() == 1


def test_results_cache_bundle_folder_and_library(spark, tmp_path):
    sinks.results_table(spark.createDataFrame([("7.0", 100.0), ("x", None)], "scan string, comment double"), str(tmp_path / "r"))
    rows = spark.read.csv(str(tmp_path / "r"), header=True).orderBy("scan").collect()
    assert [(r["scan"], r["mz_lower"], r["mz_upper"]) for r in rows] == [("7", "90.0", "110.0"), ("x", None, None)]
    (tmp_path / "a.mgf").write_text(MGF)
    calls = []
    read = lambda s, f: (calls.append(f), readers.read_mgf(s, f))[1]
    counts = [sinks.cached(spark, str(tmp_path / "a.mgf"), str(tmp_path / "cache"), read).count() for _ in range(2)]
    assert counts == [5, 5] and len(calls) == 1
    table = {"t": [{"a": 1}]}
    sinks.write_bundle(str(tmp_path / "b.json.gz"), table)
    raw = (tmp_path / "b.json.gz").read_bytes()
    assert sinks.read_bundle(raw) == table == sinks.read_bundle("data:x;base64," + base64.b64encode(raw).decode()) == sinks.read_bundle(json.dumps(table).encode())
    assert [sinks.run_folder(str(tmp_path), "run").rpartition("/")[2] for _ in range(3)] == ["run", "run_1", "run_2"]
    with sqlite3.connect(tmp_path / "l.db") as c:
        c.execute("create table lib (id integer, name text)")
        c.executemany("insert into lib values (?, ?)", [(1, "a"), (2, "b")])
    assert sinks.library_rows(str(tmp_path / "l.db"), "lib", "id", [2, 9, 1]) == [(2, "b"), (1, "a")]
    with pytest.raises(ValueError):
        sinks.library_rows(str(tmp_path / "l.db"), "lib; drop table lib", "id", [1])


@pytest.mark.parametrize(("text", "message"), [
    ("BEGIN IONS\nBEGIN IONS\n", "inside a block"), ("END IONS\n", "without a block"), ("100 1\n", "outside"), ("BEGIN IONS\n100 x\nEND IONS\n", "malformed"), ("BEGIN IONS\n100 1\n", "no end"),
])
def test_strict_errors(text, message):
    with pytest.raises(strict.MgfError, match=message):
        list(strict.blocks(iter(text.splitlines())))


def test_strict_records(spark, tmp_path):
    good = "BEGIN IONS\nUSI={}\nFEATURE_ID=1\nSMILES=C\nINCHIKEY=K\nPRECURSOR_MZ=100.5\nNUM_PEAKS={}\n100 1\nEND IONS\n"
    (tmp_path / "a.mgf").write_text(good.format("u", 1) + good.format("v", 5) + good.format("v", 1) + "BEGIN IONS\n100 1\nEND IONS\nEND IONS\n")
    rows = strict.read_strict(spark, str(tmp_path / "a.mgf"))
    assert [r["error"] is None for r in rows.orderBy("n").collect()] == [True] * 4 + [False]
    found = strict.library_records(rows).orderBy("n").collect()
    assert [r["problem"] for r in found] == [None, "usi repeats", "usi repeats", "no usi"] and [r["peaks_differ"] for r in found] == [False, True, False, False]


def test_describe_and_bands():
    q = "QUERY scaninfo(MS2DATA) WHERE MS2PROD=(X+10 OR 200):TOLERANCEPPM=5:INTENSITYPERCENT=10 AND MS2NL=18.01:EXCLUDED AND CHARGE=2 FILTER MS2PROD=100"
    text = describe(q)
    for part in ("MS2 scans", "X+10 or 200", "5 ppm", "10% of the base peak", "not a neutral loss", "a charge of 2", "keep only peaks of"):
        assert part in text
    assert bands(q, x=90)[0] == ("MS2PROD", pytest.approx(99.9995), pytest.approx(100.0005), 0.1, False) and bands(q)[2][4] is True


def test_elements(spark):
    rows = spark.createDataFrame([("m", "frag", 80.0, 0.5), ("m", "loss", 20.0, 0.5), ("n", "frag", 80.0, 0.2), ("n", "frag", 9.0, 0.01)], "motif string, kind string, mz double, p double")
    nodes, edges = network.elements(rows, precursor=100.0)
    assert sorted(r["id"] for r in nodes.collect()) == ["frag_80.0", "loss_20.0", "m", "n"]
    assert sorted((r["source"], r["target"], r["weight"]) for r in edges.filter("weight is null").collect()) == [("loss_20.0", "frag_80.0", None)] and edges.count() == 4


def test_alpha_and_checkpoints(spark, tmp_path):
    assert lda.trigamma(np.array([0.5, 1.0, 2.0])) == pytest.approx([np.pi**2 / 2, np.pi**2 / 6, np.pi**2 / 6 - 1], rel=1e-8)
    shares = np.random.default_rng(1).dirichlet([0.5, 2.0, 4.0], 20000)
    assert lda.newton_alpha(np.ones(3), np.log(shares).mean(axis=0)) == pytest.approx([0.5, 2.0, 4.0], rel=0.05)
    corpus = spark.createDataFrame([(f"d{i}", w, 5) for i in range(20) for w in (("a", "b") if i % 2 else ("c", "d"))], "doc string, word string, n long")
    docs = lda.bags(corpus, spark.createDataFrame([(w, k) for k, w in enumerate("abcd")], "word string, id int")).cache()
    fit = lambda epochs, start=None, after=None: lda.fit(docs, list("abcd"), 2, epochs, tol=0, start=start, after=after, learn_alpha=True)
    folder = str(tmp_path / "model")
    whole = fit(5)
    fit(3, after=lambda m: checkpoints.save(m, folder, len(m.history)))
    assert sorted(p.name for p in (tmp_path / "model").iterdir()) == ["gen-2.json", "gen-2.npz", "gen-3.json", "gen-3.npz"]
    n, model = checkpoints.restore(folder)
    resumed = fit(5, start=model)
    assert n == 3 and resumed.lam == pytest.approx(whole.lam) and resumed.alpha == pytest.approx(whole.alpha)
    (tmp_path / "model" / "gen-3.npz").write_bytes(b"damaged")
    assert checkpoints.restore(folder)[0] == 2 and checkpoints.restore(str(tmp_path / "none")) is None


def test_command_line(spark, tmp_path, capsys):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert main(["describe", "QUERY scannum(MS2DATA) WHERE MS2PROD=100"]) == 0 and "product ion at m/z 100" in capsys.readouterr().out
    (tmp_path / "a.mgf").write_text(MGF + MGF.replace("SCANS=7", "SCANS=8"))
    assert main(["query", str(tmp_path / "a.mgf"), "QUERY scaninfo(MS2DATA) WHERE MS2PROD=150.25", "--output", str(tmp_path / "q")]) == 0
    assert sorted(r["scan"] for r in spark.read.csv(str(tmp_path / "q"), header=True).collect()) == ["7", "8"]
    assert main(["topics", str(tmp_path / "a.mgf"), "--output-folder", str(tmp_path / "runs"), "--n-topics", "2", "--n-iterations", "2"]) == 0
    assert spark.read.parquet(str(tmp_path / "runs" / "a" / "theta")).count() == 4
    assert "<polyline" in (tmp_path / "runs" / "a" / "convergence.svg").read_text() and sinks.read_motifs(spark, str(tmp_path / "runs" / "a" / "motifset")).count() > 0
    assert spark.read.parquet(str(tmp_path / "runs" / "a" / "doc2spec")).count() == 2 and spark.read.parquet(str(tmp_path / "runs" / "a" / "viewer" / "gamma")).count() == 4
    assert main(["topics", str(tmp_path / "a.mgf"), "--output-folder", str(tmp_path / "runs"), "--run-name", "b", "--n-topics", "2", "--n-iterations", "2", "--library", str(tmp_path / "a.mgf")]) == 0
    assert {r["scan"] for r in spark.read.parquet(str(tmp_path / "runs" / "b" / "annotation")).collect()} <= {"7", "8"}
    assert (tmp_path / "runs" / "b" / "motifset_optimised").exists()
    assert main(["draw", "QUERY scannum(MS2DATA) WHERE MS2PROD=100"]) == 0 and "<svg" in capsys.readouterr().out
