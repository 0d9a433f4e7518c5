import pytest
from core_helpers import DATA, same_rows

from peakloom import queries, queries_files, queries_motifs  # noqa: F401
from peakloom.plans.compiler import run

SCHEMA = "scan string, ms1scan string, frag_mz double, frag_intens double, loss_mz double, loss_intens double, precmz double, rt double, polarity int, charge int, motif_id string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name]).to_arrow_table())


@pytest.fixture(scope="module")
def motifs(spark):
    rows = [("1", "m", 178.03, 0.5, None, None), ("1", "m", 250.0, 0.4, None, None), ("1", "m", None, None, 18.01, 0.2), ("2", "n", 200.0, 0.7, None, None), ("2", "n", 300.0, 0.7, None, None)]
    return spark.createDataFrame([(s, None, f, i, l, j, 400.0, 1.0, 1, 1, m) for s, m, f, i, l, j in rows], SCHEMA)


def scans(df):
    return sorted(r["scan"] for r in df.select("scan").distinct().collect())


def test_bands_are_open_and_losses_never_match_fragments(motifs):
    assert scans(run("QUERY scannum(MS2DATA) WHERE MS2PROD=178.08:TOLERANCEMZ=0.05", None, motifs)) == []
    assert scans(run("QUERY scannum(MS2DATA) WHERE MS2PROD=178:TOLERANCEMZ=0.05", None, motifs)) == ["1"]
    assert scans(run("QUERY scannum(MS2DATA) WHERE MS2PROD=18.01", None, motifs)) == []
    assert scans(run("QUERY scannum(MS2DATA) WHERE MS2NL=18.01", None, motifs)) == ["1"]
    assert scans(run("QUERY scannum(MS2DATA) WHERE MS2NL=18.01:EXCLUDED", None, motifs)) == ["2"]


def test_variable_takes_candidates_greedily(motifs):
    out = run("QUERY scaninfo(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1 AND MS2PROD=X+100:TOLERANCEMZ=0.1", None, motifs).collect()
    assert [(r["scan"], r["comment"]) for r in out] == [("2", 200.0)]
    out = run("QUERY scannum(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1 AND X=massdefect(min=0.01,max=0.1)", None, motifs).collect()
    assert [(r["scan"], r["comment"]) for r in out] == [("1", 178.03)]


def test_strict_limits_look_at_whole_scans(motifs):
    strict = lambda q: scans(run(q, None, motifs, strict_ms2=True))
    assert strict("QUERY scannum(MS2DATA) WHERE MS2PROD=250:TOLERANCEMZ=0.1:INTENSITYPERCENT=79") == ["1"]
    assert strict("QUERY scannum(MS2DATA) WHERE MS2PROD=250:TOLERANCEMZ=0.1:INTENSITYPERCENT=81") == []
    assert strict("QUERY scannum(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1:INTENSITYPERCENT=90 AND MS2PROD=X+71.97:TOLERANCEMZ=0.1:INTENSITYPERCENT=79") == ["1"]
    assert strict("QUERY scannum(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1:INTENSITYPERCENT=90 AND MS2PROD=X+71.97:TOLERANCEMZ=0.1:INTENSITYPERCENT=81") == []
    assert strict("QUERY scannum(MS2DATA) WHERE MS2PROD=178.03:TOLERANCEMZ=0.1:EXCLUDED AND MS2PROD=200:TOLERANCEMZ=0.1:INTENSITYTICPERCENT=40") == ["2"]


def test_empty_tables(spark, motifs):
    empty = motifs.limit(0)
    assert run("QUERY scaninfo(MS2DATA) WHERE MS2PROD=100", None, empty).count() == 0
    assert run("QUERY scannum(MS2DATA) WHERE MS2PROD=X:TOLERANCEMZ=0.1", None, empty).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
