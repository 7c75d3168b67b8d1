"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from blockwise.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == (pytest.approx(y, abs=2e-6, rel=1e-9) if isinstance(y, float) else y), (g, w)


@pytest.mark.parametrize("name", ["d01_pca_embeddings", "d07_plsda_embeddings", "d10_plsda_loo", "f01_diablo", "e08_compare_models", "b24_config_sweep"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "column", "n"), [("e05_permutation_test", "n_permutations", 1000), ("e12_diablo_permutation", "n_permutations", 50)])
def test_resampling_queries_run_in_full(spark, name, column, n):
    assert QUERIES[name](spark, SF).first()[column] == n


def test_stability_rounds_run_in_full(spark):
    for r in QUERIES["e07_stability_rounds"](spark, SF).collect():
        assert r["Selection_Frequency"] == pytest.approx(r["Times_Selected"] / 100)


def test_bootstrap_runs_in_full(spark):
    assert QUERIES["e06_bootstrap"](spark, "/root/testdata/sf0.01").first()["n_bootstrap"] == 1000
