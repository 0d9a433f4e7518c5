import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import scalars
from peakloom.operators import annotation, metrics, motifs, network, screening, similarity, summaries
from peakloom.operators.vectors import weighted_means
from peakloom.sources import readers, sinks


def unit(v):
    return np.asarray(v, float) / max(np.linalg.norm(v), 1e-12)


def test_annotation_chain_by_brute_force(spark):
    rng = np.random.default_rng(4)
    library = rng.normal(size=(40, 6))
    molecules = [f"m{k % 13}" for k in range(40)]
    queries = rng.normal(size=(3, 6))
    masked = {q: queries[q] + rng.normal(size=(5, 6)) * 0.5 for q in range(3)}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = annotation.annotate(
        df([(q, queries[q].tolist()) for q in range(3)], "query long, v array<double>"),
        df([(k, v.tolist()) for k, v in enumerate(library)], "id long, v array<double>"),
        df([(k, m) for k, m in enumerate(molecules)], "id long, molecule string"),
        df([(q, k, v.tolist()) for q in range(3) for k, v in enumerate(masked[q])], "motif long, variant int, v array<double>"),
        n=6, k=25, cut=0.6,
    ).collect()
    for q in range(3):
        cosine = [unit(v) @ unit(queries[q]) for v in library]
        chosen = []
        for k in sorted(range(40), key=lambda k: -cosine[k])[:25]:
            if molecules[k] not in [molecules[j] for j in chosen] and len(chosen) < 6:
                chosen.append(k)
        rows = np.array([[unit(library[k]) @ unit(v) for v in masked[q]] for k in chosen])
        alike = np.array([[unit(a) @ unit(b) for b in rows] for a in rows])
        labels = screening.complete_linkage(alike, 0.6)
        want = {(k, molecules[k], place + 1) for place, k in enumerate(chosen) if labels[place] == labels[0]}
        assert {(r["id"], r["molecule"], r["rank"]) for r in got if r["motif"] == str(q)} == want


def test_embeddings_and_matrices(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, v array<double>")
    cells = spark.createDataFrame([("d", "a", 4.0), ("d", "b", 1.0), ("d", "zz", 9.0), ("e", "zz", 1.0)], "doc string, word string, w double")
    assert [(r["doc"], [round(x, 9) for x in r["v"]]) for r in weighted_means(cells, vectors).collect()] == [("d", [round(2 / 3, 9), round(1 / 3, 9)])]
    scores = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.25), (1, 8, 0.1)], "query int, id int, score double")
    assert [(r["id"], r["1"], r["2"]) for r in annotation.wide_scores(scores, [1, 2]).orderBy("id").collect()] == [(7, 0.5, 0.25), (8, 0.1, None)]
    docs = spark.createDataFrame([(k, ["frag@1", "frag@2"] if k % 2 else ["loss@1", "loss@2"]) for k in range(30)], "doc int, words array<string>")
    trained = {r["word"]: r["v"] for r in annotation.word_vectors(docs, size=4, iterations=2).collect()}
    assert set(trained) == {"frag@1", "frag@2", "loss@1", "loss@2"} and all(len(v) == 4 for v in trained.values())
    peaks = spark.createDataFrame([("s", 100.0, 1.0, None), ("s", 150.0, 0.5, None), ("s", 200.0, 0.1, None)], "scan string, frag_mz double, frag_intens double, loss_mz double")
    library = annotation.reference_library(peaks, spark.createDataFrame([("frag@100.0", [1.0]), ("frag@200.0", [0.0])], "word string, v array<double>"), 1)
    assert library.first()["v"] == [pytest.approx(1 / (1 + 0.1**0.5))]


def test_cosine_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (30, 3)).astype(float)
    x[3] = 0
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    score = np.array([[unit(a) @ unit(b) for b in x] for a in x])
    asked = table.filter("id < 8").withColumnRenamed("id", "query")
    got = {(r["query"], r["rank"]): r["id"] for r in similarity.cosine_top(table, asked, 4).collect()}
    for q in range(8):
        best = sorted(range(30), key=lambda k: (-round(score[q, k], 9), k))[:4]
        assert [round(score[q, got[q, r]], 9) for r in range(1, 5)] == [round(score[q, k], 9) for k in best]
    pairs = {(r["query"], r["id"]) for r in similarity.cosine_pairs(table, asked, 0.49).collect()}
    assert pairs == {(q, k) for q in range(8) for k in range(30) if score[q, k] >= 0.49}
    assert similarity.cosine_top(table.limit(0), asked, 4).count() == 0


def test_screen_by_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = [sorted(set((rng.zipf(1.4, rng.integers(0, 12)) % 40).tolist())) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "a int, set array<int>")
    got = {(r["a"], r["b"]): r["score"] for r in similarity.screen(df, df.withColumnRenamed("a", "b"), 0.5).collect()}
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b))}
    assert got == pytest.approx(want)


def test_motif_spectra_and_stores(spark, tmp_path):
    features = spark.createDataFrame([(0, "frag@50.127", 0.2), (0, "loss@18.01", 0.4), (0, "frag@20.0", 0.1), (0, "other", 0.9), (1, "other", 1.0)], "topic int, word string, p double")
    made = motifs.motif_spectra(features, 2, 1, "set")
    rows = sorted((r["motif_id"], r["kind"], r["peak_idx"], r["mz"], round(r["i"], 9), r["ms2accuracy"]) for r in made.collect())
    assert rows == [("motif_0", "frag", 1, 20.0, 0.25, 0.005), ("motif_0", "frag", 2, 50.13, 0.5, 0.005), ("motif_0", "loss", 1, 18.01, 1.0, 0.005)]
    ms1, ms2 = motifs.motif_tables(made)
    assert ms1.count() == 1 and ms2.filter("frag_mz is null").count() == 1 and ms2.select("scan").distinct().count() == 1
    sinks.write_tables(str(tmp_path / "db"), ms1=ms1, ms2=ms2)
    again = sinks.read_tables(spark, str(tmp_path / "db"), "ms1", "ms2")
    assert again["ms2"].count() == 3 and again["ms1"].columns == ms1.columns
    body = json.loads(motifs.as_json(made, {"motifset": "set_name"}).first()["json"])
    assert body["peaks_json"] == [[20.0, 0.25], [50.13, 0.5]] and body["set_name"] == "set"
    doubled = made.withColumn("i", F.col("i") * 2)
    assert motifs.joint_normalised(doubled).agg(F.max("i")).first()[0] == 1.0
    assert motifs.joint_normalised(made.withColumn("i", F.col("i") / 2), only_above_one=True).agg(F.max("i")).first()[0] == 0.5
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "m.m2m").write_text("#NAME m\nfragment_100.5,0.5\nloss_18.01,0.25\n")
    motifs.convert_legacy(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert sinks.read_motifs(spark, str(tmp_path / "new")).count() == 2
    assert motifs.motif_files(spark, str(tmp_path / "new")).count() >= 1


def test_ledgers(spark):
    rows = spark.range(25).select(F.col("id").alias("n"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("value"))
    ledger = summaries.row_ledger(rows, 10)
    assert sorted((r["start"], r["end"]) for r in ledger.collect()) == [(0, 10), (10, 20), (20, 25)]
    assert summaries.ledger_faults(rows, ledger, 10).count() == 0
    other = rows.withColumn("value", F.when(F.col("n") == 12, F.lit("x")).otherwise(F.col("value")))
    assert [(r["start"], r["fault"]) for r in summaries.ledger_faults(other, ledger, 10).collect()] == [(10, "changed")]
    assert {(r["start"], r["fault"]) for r in summaries.ledger_faults(rows, ledger.filter("start <> 10"), 10).collect()} == {(10, "missing"), (20, "gap")}


def test_agreements_and_graphs(spark, tmp_path):
    rng = np.random.default_rng(5)
    a = rng.dirichlet(np.full(9, 0.2), 4)
    found = metrics.topic_agreement(a, a[[2, 0, 3, 1]], 3)
    assert found["pairs"] == [(0, 1), (1, 3), (2, 0), (3, 2)] and found["cosine_mean"] == pytest.approx(1) and found["jaccard_mean"] == 1
    rows = metrics.agreement_rows({(m, s): rng.dirichlet(np.full(9, 0.2), 4) for m in "xy" for s in (1, 2, 3)}, 3)
    assert [r["comparison"] for r in rows] == ["cross_seed"] * 6 + ["between_methods"] * 3
    edges = spark.createDataFrame([("m<1", "frag_10.0", 0.5, "red"), ("m<1", "loss_18.0", 0.2, "blue")], "motif string, feature string, weight double, color string")
    network.write_graphml(edges, str(tmp_path / "g"))
    (part,) = (tmp_path / "g").glob("part-*")
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(part.read_bytes())
    tags = [e.tag.rpartition("}")[2] for e in tree.iter()]
    assert tags.count("node") == 3 and tags.count("edge") == 2 and tree.find(".//{*}edge").get("source") == "m<1"


def test_keys_and_lists(spark):
    df = spark.createDataFrame([("  Precursor M/Z ", ["a", "b"])], "k string, w array<string>")
    r = df.select(scalars.normal_key(F.col("k")).alias("k"), scalars.listed(F.col("w")).alias("l"), scalars.document_key(F.col("w")).alias("d")).first()
    assert (r["k"], r["l"], r["d"]) == ("precursor m/z", "a, b", __import__("hashlib").md5(b"ab").hexdigest()) and scalars.accuracy(2) == 0.005
    assert readers.read_spectra(spark, df) is df


def test_screening_a_store_in_one_call(spark):
    vectors = spark.createDataFrame([("frag@100.00", [1.0, 0.0]), ("frag@200.00", [0.0, 1.0]), ("loss@18.00", [1.0, 1.0])], "word string, v array<double>")
    peaks = "scan string, motif_id string, motifset string, charge int, frag_mz double, frag_intens double, loss_mz double, loss_intens double"
    store = spark.createDataFrame([("k1", "m1", "s", 1, 100.0, 1.0, None, None), ("k1", "m1", "s", 1, None, None, 18.0, 0.25), ("k2", "m2", "s", 1, 200.0, 1.0, None, None), ("k3", "m3", "t", 1, 100.0, 1.0, None, None)], peaks)
    spectra = spark.createDataFrame([("7", 100.0, 4.0), ("8", 200.0, 1.0), ("9", 100.0, 1.0), ("9", 200.0, 1.0)], "scan string, frag_mz double, frag_intens double")
    own = spark.createDataFrame([("mine", 200.0, 1.0)], "motif_id string, frag_mz double, frag_intens double")
    query = "QUERY scannum(MS2DATA) WHERE MS2PROD=100:TOLERANCEMZ=0.1"
    hits = annotation.screen_store((None, store), query, vectors, spectra, own, least=0.3)
    assert {(r["hit_id"], r["screen_type"], r["score"], r["ref_motif_id"], r["ref_motifset"], r["ref_charge"]) for r in hits.collect()} == {
        ("7", "spectrum-motif", 0.95, "m1", "s", 1), ("7", "spectrum-motif", 1.0, "m3", "t", 1), ("8", "spectrum-motif", 0.32, "m1", "s", 1),
        ("9", "spectrum-motif", 0.89, "m1", "s", 1), ("9", "spectrum-motif", 0.71, "m3", "t", 1), ("mine", "motif-motif", 0.32, "m1", "s", 1),
    }
    ranked = annotation.ranked_hits(hits).orderBy("place").collect()
    assert [r["score"] for r in ranked] == [1.0, 0.95, 0.89, 0.71, 0.32, 0.32] and [r["hit_id"] for r in ranked[-2:]] == ["8", "mine"]
    with pytest.raises(ValueError, match="no motif"):
        annotation.screen_store((None, store), query.replace("100", "999"), vectors, spectra)
    with pytest.raises(ValueError, match="needed"):
        annotation.screen_store((None, store), query, vectors)
