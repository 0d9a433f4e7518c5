"""Peaks at the very tolerance, and parts that grow with the table."""

import numpy as np
import pytest

from peakloom.operators import topics


def test_a_loss_that_rounding_takes_past_the_tolerance_has_shares(spark):
    mz = np.arange(1_000_000, 3_000_000) / 10_000
    precursor = (np.arange(1_000_000, 3_000_000) + 195_000) / 10_000
    off = 20.0 - (precursor - mz)
    k = int(np.argmax((off > 0.5) & (off <= 0.5 + 1e-13)))
    assert 0.5 < off[k] <= 0.5 + 1e-12
    peaks = spark.createDataFrame([("d", 1, float(mz[k]), float(precursor[k]))], "doc string, peak_idx int, mz double, precursor double")
    theta = spark.createDataFrame([("d", 0, 1.0)], "doc string, topic int, p double")
    beta = spark.createDataFrame([(0, "loss", 20.0, 1.0)], "topic int, kind string, value double, p double")
    assert [tuple(r) for r in topics.shares(peaks, theta, beta, 0.5).collect()] == [("d", 1, 0, 1.0)]


def test_word_corpora_are_dealt_into_the_parts_asked_for(spark):
    from core_helpers import DATA

    from peakloom.operators import peaks
    from peakloom.sources.adapters import ms2_peaks, scan_parts

    table = ms2_peaks(spark, DATA)
    for losses in (False, True):
        dealt = peaks.words(table, 0, losses, parts=9)
        assert dealt.rdd.getNumPartitions() == 9
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, peaks.words(table, 0, losses).collect()))
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert scan_parts(spark, DATA, 100) == -(-rows // 100) and scan_parts(spark, DATA, 10**9) == spark.sparkContext.defaultParallelism


def test_sketches_are_made_by_all_cores(spark):
    from core_helpers import DATA

    from peakloom import queries

    assert queries.QUERIES["sketch_minhash"](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_go_to_two_bins_and_meet_all_within_the_margin(spark):
    from pyspark.sql import functions as F

    from peakloom.operators import screening

    whole, half = spark.range(1, 200).select(F.col("id").cast("double").alias("b")), spark.range(2, 400).select((F.col("id") * 0.5).alias("a"))
    assert screening.binned(whole, "b", 0.5).count() == 2 * 199
    got = {tuple(r) for r in screening.near(half, whole, "a", "b", 0.5).collect()}
    assert got == {(x / 2, float(y)) for x in range(2, 400) for y in range(1, 200) if abs(x / 2 - y) <= 0.5}


def test_a_cell_of_few_topics_counts_with_its_own_columns(spark, monkeypatch):
    from peakloom.operators import topic_table

    monkeypatch.setattr(topic_table, "BLOCK_CELLS", 3100)
    cells = spark.range(4000).selectExpr("cast(id % 1000 as string) as doc", "id", "1 as n")
    sizes = [r["count"] for r in topic_table.blocked(cells, 3).groupBy("block").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) * 3 * 8 < 3100 * 8 / 4  # topics' numbers are a small part of what a block of theirs takes


def test_training_and_inference_hold_blocks_of_bounded_cells(spark, monkeypatch):
    from peakloom.operators import topic_table

    most, meet = [], topic_table.meet

    def noted(rows, *rest):
        most.append(max(r["count"] for r in rows.groupBy("block").count().collect()))
        return meet(rows, *rest)

    monkeypatch.setattr(topic_table, "BLOCK_CELLS", 3100)
    monkeypatch.setattr(topic_table, "meet", noted)
    for times in (1, 4):
        cells = spark.range(2000 * times).selectExpr("cast(id div 4 as string) as doc", "id % 40 as id", "1 as n")
        rows = spark.range(40).selectExpr("id", "array(1D + id % 5, 1D + id % 3, 1D) as v")
        model = topic_table.fit(cells, topic_table.given(rows, 40, np.full(3, 0.1)), epochs=1, steps=1)
        assert model.totals.sum() == pytest.approx(2000 * times + 3 * 40 * 0.01)
        assert topic_table.infer(cells, model, steps=1).count() == 500 * times * 3
    assert len(most) == 4 and max(most) < 400  # 100 a block on average, where topics alone would deal 1,000 or more


def test_only_compounds_at_the_edges_of_splits_are_shuffled(spark, tmp_path):
    from peakloom.sources import readers

    edges = []

    def counted(batches):
        for b in readers._parted(batches):
            edges.extend(b["edge"].to_pylist())
            yield b

    (tmp_path / "a.msp").write_text("\n" + "".join(("" if k % 3 else f"Name: n{k}\n") + f"Num Peaks: 40\n{''.join(f'{k}.{j} {j + 1}{chr(10)}' for j in range(40))}" + "\n" * (1 + k % 2) for k in range(60)))
    once = sorted(map(str, readers.read_msp(spark, str(tmp_path / "a.msp")).collect()))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        splits = spark.read.text(str(tmp_path / "a.msp")).rdd.getNumPartitions()
        assert splits > 20 and once == sorted(map(str, readers.read_msp(spark, str(tmp_path / "a.msp")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(once) == 60 * 40
    head, value = [{"file": "f", "split": 0, "before": 0}] + [None] * 6, ["a", "", "b", "c", "", "", "d"]
    import pyarrow as pa

    list(counted([pa.RecordBatch.from_arrays([pa.array(head), pa.array(value), pa.array([v == "" for v in value])], ["head", "value", "blank"])]))
    assert edges == [True, False, True]


def test_norms_are_taken_in_parts_of_a_split_over_blocks_of_one_name(spark, tmp_path):
    from peakloom.sources import readers

    block = "BEGIN IONS\nSCANS={}\nPEPMASS=200.5\n50.5 {}\n60.5 0\n70.5 {}\nEND IONS\n"
    (tmp_path / "a.mgf").write_text(block.format(1, 10, 30) + block.format(2, 5, 5) + block.format(1, 40, 20) + "BEGIN IONS\nSCANS=3\nEND IONS\n")
    rows = readers.read_mgf(spark, str(tmp_path / "a.mgf"))
    got = sorted((r["scan"], r["peak_idx"], r["frag_mz"], r["i_norm"], r["i_tic_norm"]) for r in rows.collect())
    assert got == [("1", 0, 50.5, 0.25, 0.1), ("1", 0, 50.5, 1.0, 0.4), ("1", 2, 70.5, 0.5, 0.2), ("1", 2, 70.5, 0.75, 0.3), ("2", 0, 50.5, 1.0, 0.5), ("2", 2, 70.5, 1.0, 0.5)]
    assert rows.rdd.getNumPartitions() == readers.PARTS_OF_SPLIT


def test_steps_in_slices_equal_plain_ones_and_tiny_weights_do_not_vanish(monkeypatch):
    from peakloom.operators import lda

    rng = np.random.default_rng(4)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 5, 40))])
    ids, counts, alpha = rng.integers(0, 9, bounds[-1]), rng.integers(1, 9, bounds[-1]).astype(float), np.array([1e-5, 0.1, 0.2])
    log_beta = rng.normal(-3, 2, (9, 3))
    log_beta[:2] = [[-1.0, -3e5, -4e5], [-4e5, -3e5, -1.0]]
    monkeypatch.setattr(lda, "AT_ONCE", 7)
    gamma, weighed = lda.local_steps(ids, counts, bounds, log_beta, alpha, 5, 0.0)
    for d, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own, n = alpha + counts[low:high].sum() / 3, counts[low:high, None]
        for _ in range(5 if high > low else 0):
            score = lda.expected_log(own) + log_beta[ids[low:high]]
            phi = np.exp(score - score.max(axis=1, keepdims=True))
            phi *= n / phi.sum(axis=1, keepdims=True)
            own = alpha + phi.sum(axis=0)
        assert np.allclose(gamma[d], own, rtol=1e-9) and (high == low or np.allclose(weighed[low:high], phi, rtol=1e-9, atol=1e-12))
    assert np.isfinite(gamma).all()


def test_a_kernel_sees_few_pairs_at_once(spark, monkeypatch):
    from peakloom.operators import similarity

    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 64)

    def kernel(keys_a, a, keys_b, b):
        assert len(keys_a) * len(keys_b) <= 64
        return np.nonzero((keys_a[:, None] + keys_b) % 5 == 0) + (np.ones(int(((keys_a[:, None] + keys_b) % 5 == 0).sum())),)

    side = spark.range(40, numPartitions=2).selectExpr("id as key", "cast(0 as bigint) as part", "cast('12345678' as binary) as data")
    for shared in (1 << 26, 0):
        monkeypatch.setattr(similarity, "SHARED_BYTES", shared)
        got = {(r["a"], r["b"]) for r in similarity.matched(side, side, kernel, ("a", "b", "s"), 8, (40, 40)).collect()}
        assert got == {(i, j) for i in range(40) for j in range(40) if (i + j) % 5 == 0}
