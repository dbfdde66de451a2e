"""Exact counts beside sketches: no row is copied for them, nulls do not count."""

from __future__ import annotations

import duckdb
import pytest

from lorewright.plans import catalog


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i % 9 or None, i % 5 or None, None if i % 4 == 3 else "ANR"[i % 4], float(i % 7)) for i in range(400)] + [(None, None, "X", 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_same_as_oracle_with_nulls(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["approx_distinct"](spark, folder)
    assert {tuple(r) for r in got.select("l_returnflag", "parts", "orders", "parts_near", "orders_near", "median").collect()} == set(con.execute(catalog.ORACLES["approx_distinct"]).fetchall())


def test_no_key_carries_the_sketches(spark, folder):
    plan = catalog.QUERIES["approx_distinct"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
