"""Registered queries against DuckDB on the smallest tables, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
SAMPLE = ["eb_slope", "paired_index", "size_matched_clusters", "auc_tie_averaged", "conformal_by_stratum", "bootstrap_increment",
          "nested_cv_ridge", "harmonised_pairs", "leave_one_out", "coloc_posteriors", "ld_pairs", "reconcile_values"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(contract.oracle_sql()[name])
    want = norm([c[0] for c in rel.description], rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, abs_tol=2e-6)), (name, g, w)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
