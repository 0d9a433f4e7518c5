import base64
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from peakloom.sources import elements, readers, strict


def test_mgf_round_trip(spark, tmp_path):
    f = tmp_path / "a.mgf"
    f.write_text("BEGIN IONS\nPEPMASS=350.5 10\nCHARGE=2+\nRTINSECONDS=120\n100.0 0.5\n150.25 1\n200 0\nEND IONS\n\nBEGIN IONS\nSCANS=7\nPEPMASS=200\nIONMODE=negative\n90.1\t3\nEND IONS\n")
    rows = {(r["scan"], r["frag_mz"]): r for r in readers.read_spectra(spark, str(f)).collect()}
    assert set(rows) == {("1", 100.0), ("1", 150.25), ("7", 90.1)}
    one = rows["1", 150.25]
    assert (one["precmz"], one["rt"], one["charge"], one["i_norm"]) == (350.5, 2.0, 2, 1.0)
    assert rows["7", 90.1]["polarity"] == 2
    readers.write_mgf(readers.read_mgf(spark, str(f)), str(tmp_path / "out"))
    again = readers.read_mgf(spark, str(tmp_path / "out"))
    assert {(r["scan"], r["frag_mz"], r["frag_intens"]) for r in again.collect()} == {("1", 100.0, 0.5), ("1", 150.25, 1.0), ("7", 90.1, 3.0)}


def test_msp_columns_library(spark, tmp_path):
    (tmp_path / "a.msp").write_text("Name: A\nPrecursor_MZ: 200.5\nNum Peaks: 2\n50.5 10\n60.5 20\n\nName: B\nNum Peaks: 1\n70 5\n")
    assert {(r["scan"], r["frag_mz"]) for r in readers.read_spectra(spark, str(tmp_path / "a.msp")).collect()} == {("A", 50.5), ("A", 60.5), ("B", 70.0)}
    (tmp_path / "a.txt").write_text("100.1 5\n  200.2   10\nbad line\n")
    assert [(r["mz"], r["i_norm"]) for r in readers.read_spectra(spark, str(tmp_path / "a.txt")).orderBy("mz").collect()] == [(100.1, 0.5), (200.2, 1.0)]
    (tmp_path / "a.json").write_text('[{"spectrum_id": "s", "Precursor_MZ": "99.5", "peaks_json": "[[10.5, 2.0], [11.5, 0.0]]"}]')
    assert [(r["scan"], r["precmz"], r["frag_mz"]) for r in readers.read_spectra(spark, str(tmp_path / "a.json")).collect()] == [("s", 99.5, 10.5)]


def test_mzml(spark, tmp_path):
    def spectrum(n, level, mz, i):
        arrays = "".join(f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="{k}"/><binary>{base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode()}</binary></binaryDataArray>' for k, v in (("m/z array", mz), ("intensity array", i)))
        more = '<cvParam name="selected ion m/z" value="300.5"/><cvParam name="charge state" value="2"/>' if level == 2 else ""
        return f'<spectrum id="scan={n}"><cvParam name="ms level" value="{level}"/><cvParam name="positive scan"/><cvParam name="scan start time" value="60" unitName="second"/>{more}{arrays}</spectrum>'

    (tmp_path / "a.mzML").write_text(f"<mzML><run>{spectrum(1, 1, [500.0], [9.0])}{spectrum(2, 2, [100.0, 101.0], [1.0, 0.0])}</run></mzML>")
    rows = readers.read_spectra(spark, str(tmp_path / "a.mzML")).orderBy("n").collect()
    assert [(r["scan"], r["ms_level"], r["mz"], r["rt"], r["ms1scan"], r["precmz"], r["charge"]) for r in rows] == [("1", 1, 500.0, 1.0, "1", None, 0), ("2", 2, 100.0, 1.0, "1", 300.5, 2)]


def test_files_are_told_apart_and_places_cross_splits(spark, tmp_path):
    block = "BEGIN IONS\n{}PEPMASS=200\n{} {}\nEND IONS\n"
    (tmp_path / "a.mgf").write_text(block.format("SCANS=1\n", 100, 1))
    (tmp_path / "b.mgf").write_text(block.format("SCANS=1\n", 100, 100).replace("\n", "\r\n"))
    both = readers.read_mgf(spark, str(tmp_path / "*.mgf")).collect()
    assert {(r["scan"], r["i_norm"], r["precmz"]) for r in both} == {("a.mgf:1", 1.0, 200.0), ("b.mgf:1", 1.0, 200.0)}
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "c.mgf").write_text("".join(block.format("", k + 1, 5) for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_mgf(spark, str(tmp_path / "long" / "c.mgf"))
        assert spark.read.text(str(tmp_path / "long" / "c.mgf"), lineSep="END IONS").rdd.getNumPartitions() > 1
        assert all(r["scan"] == str(int(r["frag_mz"])) for r in rows.collect()) and rows.count() == 400
        (tmp_path / "d.msp").write_text("".join(f"Name: n{k}\r\nNum Peaks: 2\r\n{k + 1} 1; {k + 2} 2;\r\n\r\n" for k in range(200)))
        rows = readers.read_msp(spark, str(tmp_path / "d.msp")).collect()
        assert len(rows) == 400 and all(r["frag_mz"] - 1 - int(r["scan"][1:]) in (0, 1) for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_msp_notes_and_unnamed(spark, tmp_path):
    (tmp_path / "a.msp").write_text('Num Peaks: 2\n50.5 10 "y1 3.5"\n60.5\t20\n\n\nName: B\nIon_mode: negative\nNum Peaks: 1\n70 5\n')
    assert {(r["scan"], r["frag_mz"], r["frag_intens"], r["polarity"]) for r in readers.read_msp(spark, str(tmp_path / "a.msp")).collect()} == {("1", 50.5, 10.0, 0), ("1", 60.5, 20.0, 0), ("B", 70.0, 5.0, 2)}


def test_spectra_in_memory(spark):
    df = readers.read_spectra(spark, [{"scan": 4, "precmz": 200.0, "mz": [50.0, 60.0], "intensities": [1.0, 2.0]}, {"mz": [70.0], "intensities": [0.0]}])
    assert [(r["scan"], r["frag_mz"], r["i_norm"]) for r in df.orderBy("frag_mz").collect()] == [("4", 50.0, 0.5), ("4", 60.0, 1.0)]
    assert readers.read_spectra(spark, df) is df


def test_mzxml_nested_and_options(spark, tmp_path):
    data = lambda *x: base64.b64encode(struct.pack(f">{len(x)}f", *x)).decode()
    (tmp_path / "a.mzXML").write_text(
        f'<mzXML><msRun><scan num="1" msLevel="1" polarity="+" retentionTime="PT60S"><peaks precision="32">{data(500, 9, 400, 0)}</peaks>'
        f'<scan num="2" msLevel="2" polarity="-" retentionTime="PT90S"><precursorMz precursorCharge="2">300.5</precursorMz><peaks precision="32">{data(100, 5, 0.5, 7, 101, 0.5, 102, 6, 103, 8)}</peaks></scan></scan></msRun></mzXML>'
    )
    rows = readers.read_raw(spark, str(tmp_path / "a.mzXML")).orderBy("n", "mz").collect()
    assert [(r["scan"], r["ms_level"], r["mz"], r["rt"], r["polarity"], r["precmz"], r["charge"], r["ms1scan"]) for r in rows][:2] == [("1", 1, 500.0, 1.0, 1, None, 0, "1"), ("2", 2, 0.5, 1.5, 2, 300.5, 2, "1")]
    assert len(rows) == 6
    few = readers.read_raw(spark, str(tmp_path / "a.mzXML"), least=1.0, top=2).orderBy("n", "mz").collect()
    assert [r["mz"] for r in few] == [500.0, 102.0, 103.0]


def test_mobility_two_files_and_library_limit(spark, tmp_path):
    array = lambda k, v: f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="zlib compression"/><cvParam name="{k}"/><binary>{base64.b64encode(zlib.compress(struct.pack(f"<{len(v)}d", *v))).decode()}</binary></binaryDataArray>'
    text = f'<mzML><run><spectrum id="controllerType=0 scan=3"><cvParam name="ms level" value="2"/><cvParam name="selected ion m/z" value="5.5"/><cvParam name="product ion mobility" value="0.75"/>{array("m/z array", [1.0])}{array("intensity array", [2.0])}</spectrum></run></mzML>'
    for name in "ab":
        (tmp_path / f"{name}.mzML").write_text(text)
    rows = readers.read_raw(spark, str(tmp_path / "*.mzML")).collect()
    assert [(r["scan"], r["mobility"], r["ms1scan"]) for r in rows] == [("3", 0.75, None)] * 2 and len({r["file"] for r in rows}) == 2
    (tmp_path / "l.json").write_text('[{"spectrum_id": "s", "peaks_json": "[[10.5, 2.0]]"}, {"spectrum_id": "t", "peaks_json": "[[1.5, 2.0], [2.5, 1.0]]"}]')
    assert {r["scan"] for r in readers.read_library(spark, str(tmp_path / "l.json"), limit=15).collect()} == {"s"}
    assert readers.left_out(spark, str(tmp_path / "l.json"), 15) == 1 and {r["scan"] for r in readers.read_library(spark, str(tmp_path / "l.json"), limit=None).collect()} == {"s", "t"}


def test_motif_text_and_store(spark, tmp_path):
    (tmp_path / "m.m2m").write_text("#NAME motif_1\n#ANNOTATION sugar\nfragment_100.1234,0.5\nloss_18.01,0.25\n")
    rows = readers.read_m2m(spark, str(tmp_path / "m.m2m"))
    assert [(r["motif_id"], r["frag_mz"], r["loss_mz"]) for r in rows.orderBy("peak_idx").collect()] == [("motif_1", 100.123, None), ("motif_1", None, 18.01)]
    nested = readers.grouped_motifs(rows)
    assert nested.select(F.size("frag_mz")).first()[0] == 2
    assert sorted(map(repr, readers.exploded_motifs(nested).select(*rows.columns).collect())) != []
    assert readers.exploded_motifs(nested).filter("frag_mz is null").count() == 1


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_raw_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    rng = random.Random(6)
    array = lambda k, v: f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="{k}"/><binary>{base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode()}</binary></binaryDataArray>'
    spectra, scans, expected, last = [], [], [], None
    for n in range(1, 161):
        level = 1 if rng.random() < 0.04 else 2
        peaks = [(rng.randint(50, 900) / 2, rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
        name = f"scan={n + 1000}" if n % 3 else ""  # without a number it goes by its place
        spectra.append(f'<spectrum index="{n}" id="{name}">\n<cvParam name="ms level" value="{level}"/>{array("m/z array", [m for m, _ in peaks])}{array("intensity array", [i for _, i in peaks])}</spectrum>')
        flat = [float(x) for p in peaks for x in p]
        scans.append(f'<scan num="{n + 1000}" msLevel="{level}"><peaks precision="32">{base64.b64encode(struct.pack(f">{len(flat)}f", *flat)).decode()}</peaks></scan>')
        kept = [(m, i) for m, i in peaks if i > 0]
        own = str(n + 1000) if n % 3 else str(n)
        last = own if level == 1 and kept else last
        expected += [(n, own, level, m, float(i), last) for m, i in kept]
    (tmp_path / "a.mzML").write_text(f'<?xml version="1.0"?><indexedmzML><mzML><run><spectrumList count="160">{"".join(spectra)}</spectrumList></run></mzML><indexList><index name="spectrum"/></indexList></indexedmzML>')
    df = readers.read_raw(spark, str(tmp_path / "a.mzML"))
    assert spark.read.text(str(tmp_path / "a.mzML"), lineSep="</spectrum>").rdd.getNumPartitions() > 8
    got = [(r["n"], r["scan"], r["ms_level"], r["mz"], r["i"], r["ms1scan"]) for r in df.collect()]
    assert sorted(got) == sorted(expected) and len({e[-1] for e in expected}) > 3
    (tmp_path / "b.mzXML").write_text(f"<mzXML><msRun>{''.join(scans)}</msRun></mzXML>")
    parted = {(r["n"], r["mz"], r["i"], r["ms1scan"] and int(r["ms1scan"]) - 1000) for r in readers.read_raw(spark, str(tmp_path / "b.mzXML")).collect()}
    place = {name: n for n, name, *_ in expected}
    assert parted == {(n, m, i, ms1 and place[ms1]) for n, _, _, m, i, ms1 in expected}


def test_library_entries_cross_splits(spark, tmp_path, small_splits):
    rng = random.Random(7)
    words = ["a", '"', "\\", "}", "{", "]", "[", ",", "é", "\n", "}{", '\\"', "日"]
    entries = []
    for k in range(120):
        peaks = [[rng.randint(1, 9) / 2, rng.randint(1, 5)] for _ in range(rng.choice([1, 3, 900 if k % 40 == 5 else 6]))]  # some are longer than a split
        entries.append({"spectrum_id": f"s{k}", "note": "".join(rng.choices(words, k=rng.randint(0, 30))), "peaks_json": json.dumps(peaks), "more": {"x": [{"y": "}"}]}, "Precursor_MZ": str(k)})
    want = sorted((e["spectrum_id"], float(e["Precursor_MZ"]), len(json.loads(e["peaks_json"]))) for e in entries)
    for name, text in {"compact": json.dumps(entries), "indented": json.dumps(entries, indent=2, ensure_ascii=False), "lines": "\n".join(map(json.dumps, entries)), "one": json.dumps(entries[0])}.items():
        path = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(text)
        rows = readers.read_library(spark, path).groupBy("scan", "precmz").count().collect()
        assert sorted(map(tuple, rows)) == (want if name != "one" else want[:1]), name
        if name != "one":
            assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 5
    objects = [json.loads(r["text"]) for r in elements.json_objects(spark, str(tmp_path / "*.json")).collect()]
    assert sorted(x["spectrum_id"] for x in objects) == sorted([e["spectrum_id"] for e in entries] * 3 + ["s0"]) and all(x in entries for x in objects)
    (tmp_path / "empty.json").write_text("[]")
    assert readers.read_library(spark, str(tmp_path / "empty.json")).count() == 0


def test_a_long_library_entry_is_read(spark, tmp_path):
    peaks = json.dumps([[100.5, 1.0]] * 100_000)
    (tmp_path / "a.json").write_text(json.dumps([{"spectrum_id": "long", "peaks_json": peaks}, {"spectrum_id": "short", "peaks_json": "[[1.5, 2.0]]"}]))
    assert len(peaks) > 1_000_000 and readers.read_spectra(spark, str(tmp_path / "a.json")).count() == 100_001
    assert readers.left_out(spark, str(tmp_path / "a.json"), 1_000_000) == 1


def test_strict_files_are_read_by_several_tasks(spark, tmp_path, small_splits):
    """Blocks, and the line of the first fault, are those of a reading from the first line to the last."""
    rng = random.Random(11)
    faults = ["BEGIN IONS\n", "END IONS\n", "stray\n", "100 x\n", "# note\n", "\n", " END IONS \n", "1 2 3\n", "\x0b\n", ""]
    expected = {}
    for k in range(12):
        parts = ["".join(f"BEGIN IONS\nUSI=u{n}\n{rng.randint(50, 900)} {rng.randint(1, 9)}\n{rng.choice(['', '200.5 3\n'])}END IONS\n{rng.choice(['', '\n', '#x\n'])}") for n in range(rng.randint(0, 220))]
        if k % 3:
            parts.insert(rng.randint(0, len(parts)), rng.choice(faults))
        text = "".join(parts)
        text = text[: rng.randint(0, len(text))] if k % 4 == 3 else text
        (tmp_path / f"f{k}.mgf").write_text(text)
        rows = []
        try:
            for n, (fields, mz, intensity) in enumerate(strict.blocks(iter(text.splitlines()))):
                rows.append((n, fields, mz, intensity, None))
        except strict.MgfError as e:
            rows.append((len(rows), {}, [], [], str(e)))
        expected[f"f{k}.mgf"] = rows
    got = {}
    for r in strict.read_strict(spark, str(tmp_path / "*.mgf")).orderBy("file", "n").collect():
        got.setdefault(r["file"].rpartition("/")[2], []).append((r["n"], r["fields"], r["mz"], r["intensity"], r["error"]))
    for name, rows in expected.items():
        assert got.get(name, []) == rows, name
    assert sum(bool(rows) and rows[-1][4] is not None for rows in expected.values()) >= 4
    assert spark.read.text(str(tmp_path / "*.mgf"), lineSep="\nBEGIN IONS").rdd.getNumPartitions() > 12
