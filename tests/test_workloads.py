"""Every registered query at the smallest scale factor, against its SQL twin where it has one."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.WORKLOADS))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in ORACLE:
        verdict = check.compare(df, rows, duck.sql(ORACLE[name]))
        assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_survey_lines_are_claimed():
    """Every line of these kinds has a query that calls its operator."""
    claimed = {line for w in entry.WORKLOADS.values() for line in w.covers.split()}
    want = {"S": 22, "F": 14, "J": 20, "W": 10, "T": 12, "U": 6, "R": 6}
    assert not {f"{kind}{n}" for kind, top in want.items() for n in range(1, top + 1)} - claimed
    assert {"A30", "E19", "E21", "E22", "E23"} <= claimed
