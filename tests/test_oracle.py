"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from odflow.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "colN" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    drows = Counter(tuple(_norm(r[i]) for i in order) for r in res.fetchall())
    srows = Counter(tuple(_norm(x) for x in r) for r in sdf.collect())
    assert srows == drows


@pytest.mark.parametrize("name", ["od_flows_both", "box_heat", "classify_stops", "segment_flow",
                                  "individual_trips", "crosstab_share_all", "trip_direction"])
def test_no_cartesian_product(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
