"""Every core query against its DuckDB oracle at the smallest scale."""

import math
import os

import duckdb
import pytest

from lectern import registry
from lectern.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.6f}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    theirs = duck.sql(registry.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in ours.collect())
    at = [theirs.columns.index(c) for c in names]
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


def test_no_python_or_cartesian_in_core_plans(spark):
    for name in ("a2_full_recompute", "k3_keyword_top_5", "v2_exact_top_10", "x7_attack_category", "j12_cache_lookup"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan, name
