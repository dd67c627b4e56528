import sys

import pytest
from oracle import check
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from orrery.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count()


def test_entry(spark):
    df = entry.entry(spark)
    assert isinstance(df.schema, StructType) and df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("last, years", [("2004-12-31", 5), ("2004-06-30", 4)])
def test_rising_terms_takes_every_whole_year(spark, tmp_path, last, years):
    days = [f"{y}-03-01" for y in range(2000, 2004)] + [last]
    spark.createDataFrame(enumerate(days), "o_orderkey long, day string").selectExpr("o_orderkey", "timestamp(day) o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 1) for k in range(5)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "red")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["rising_terms"](spark, str(tmp_path)).collect()] == [("red", years, 0.0)]


def test_core_queries_stay_where_a_package_is_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "orrery.llm.queries", None)
    assert entry.queries() == catalog.QUERIES and entry.oracle_sql() == catalog.ORACLES
