"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("yearly_counts", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def yearly_counts(spark, sf_dir):
    """Orders per calendar year; years without orders are absent."""
    return table(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
