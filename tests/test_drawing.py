"""Queries as shapes, and motifs optimised from a library in one call."""

import xml.etree.ElementTree as ET


from peakloom.operators import annotation
from peakloom.plans import drawing


def test_shapes_of_all_conditions():
    q = "QUERY scaninfo(MS2DATA) WHERE MS1MZ=X:TOLERANCEMZ=0.1:INTENSITYMATCH=Y:INTENSITYMATCHREFERENCE:INTENSITYPERCENT=20 AND MS1MZ=X+2:TOLERANCEMZ=0.2:INTENSITYMATCH=Y*0.5:INTENSITYMATCHPERCENT=10 AND X=range(min=100, max=600) AND MS2NL=18:TOLERANCEPPM=1000:EXCLUDED AND MS2PROD=(100 OR 150)"
    got = [(s.level, s.field, s.what, s.value, round(s.low, 6), round(s.high, 6), round(s.bottom, 6), round(s.top, 6), s.excluded) for s in drawing.shapes(q, 300.0, 0.8, 700.0)]
    assert got == [
        (1, "MS1MZ", "band", 0, 299.9, 300.1, 0.0, 0.8, False), (1, "MS1MZ", "least", 0, 299.9, 300.1, 0.2, 0.2, False),
        (1, "MS1MZ", "band", 0, 301.8, 302.2, 0.0, 0.4, False), (1, "MS1MZ", "match", 0, 301.8, 302.2, 0.36, 0.36, False), (1, "MS1MZ", "match", 0, 301.8, 302.2, 0.44, 0.44, False),
        (1, "X", "limit", 0, 100.0, 100.0, 0.0, 1.0, False), (1, "X", "limit", 1, 600.0, 600.0, 0.0, 1.0, False),
        (2, "MS2NL", "band", 0, 681.982, 682.018, 0.0, 1.0, True), (2, "MS2PROD", "band", 0, 99.9, 100.1, 0.0, 1.0, False), (2, "MS2PROD", "band", 1, 149.9, 150.1, 0.0, 1.0, False),
    ]
    assert drawing.shapes("QUERY scannum(MS2DATA) WHERE MS2PROD=ANY:MASSDEFECT=massdefect(min=0.1,max=0.2)") == []


def test_documents_are_well_formed():
    text = drawing.visualise("QUERY scannum(MS2DATA) WHERE MS2PROD=100 AND MS2NL=18:EXCLUDED", peaks={2: [(100.0, 5.0), (1200.0, 10.0)], 1: []})
    root = ET.fromstring(text)
    assert root.find("{*}title").text.startswith("QUERY") and len(root.findall(".//{*}rect")) == 2
    assert "m/z 0 to 1200" in text and len(root.findall(".//{*}path")) == 2 + 2
    assert ET.fromstring(drawing.curve([3.0, 2.0, 1.5], "perplexity")).find("{*}polyline").get("points").count(",") == 3
    assert ET.fromstring(drawing.curve([])) is not None and ET.fromstring(drawing.curve([1.0, 1.0], "a<b")) is not None


def test_peaks_in_bands(spark):
    peaks = spark.createDataFrame([("a", 100.0, 5.0, 300.0), ("a", 100.05, 10.0, 300.0), ("a", 282.0, 2.0, 300.0), ("b", 5.0, 1.0, 300.0)], "scan string, frag_mz double, frag_intens double, precmz double")
    got = {tuple(r) for r in drawing.drawn_peaks("QUERY scannum(MS2DATA) WHERE MS2PROD=100 AND MS2NL=18", peaks).collect()}
    assert got == {("a", 0, 0, "MS2PROD", 2, 1.0), ("a", 1, 0, "MS2NL", 1, 0.2)}
    assert drawing.drawn_peaks("QUERY scannum(MS1DATA) WHERE MS1MZ=100", peaks).count() == 0


def test_optimised_motifs_keep_what_their_hits_share(spark):
    motifs = spark.createDataFrame([("motif_0", "frag", 1, 100.0, 1.0), ("motif_0", "frag", 2, 200.0, 0.5), ("motif_0", "loss", 1, 18.0, 0.5), ("motif_1", "frag", 1, 55.0, 1.0), ("motif_1", "frag", 2, 77.0, 0.25)], "motif_id string, kind string, peak_idx int, mz double, i double")
    library = spark.createDataFrame(
        [(f"s{k}", 300.0, mz, 1.0) for k in range(3) for mz in (100.0, 282.0, 290.0 + k)] + [("t", 400.0, 55.0, 1.0), ("t", 400.0, 56.0, 1.0), ("u", 500.0, 77.0, 1.0)],
        "scan string, precmz double, frag_mz double, frag_intens double",
    )
    axis = {"frag@100.00": 0, "loss@18.00": 0, "frag@200.00": 1, "frag@55.00": 2, "frag@77.00": 3}
    vectors = spark.createDataFrame([(w, [float(k == a) for k in range(4)]) for w, a in axis.items()], "word string, v array<double>")
    hits, best = annotation.optimised_motifs(motifs, library, vectors, n=3, k=3)
    found = {}
    for r in hits.collect():
        found.setdefault(r["motif"], set()).add(r["scan"])
    assert found[0] == {"s0", "s1", "s2"} and "t" in found[1]
    kept = {(r["motif_id"], r["kind"], r["mz"]) for r in best.collect()}
    assert {x for x in kept if x[0] == "motif_0"} == {("motif_0", "frag", 100.0), ("motif_0", "loss", 18.0)}
