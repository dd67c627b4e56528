"""Queries on growth, concentration and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import growth
from .catalog import query, table

def by_customer(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


TREND_SQL = """
counts AS (SELECT {by}, year(o_orderdate) AS year, count(*) AS n FROM j WHERE o_orderdate IS NOT NULL GROUP BY 1, 2),
t AS (SELECT {by}, count(*) AS years, regr_slope(n, year) AS s,
  pow(arg_max(n, year)::DOUBLE / arg_min(n, year), 1.0 / greatest(1, max(year) - min(year))) - 1 AS g FROM counts GROUP BY 1),
trend AS (SELECT {by}, CASE WHEN years < 2 THEN 0.0 ELSE g END AS cagr, CASE WHEN years < 2 THEN 0.0 ELSE s END AS slope,
  CASE WHEN years < 2 THEN 'stable' WHEN s > 0.5 THEN 'surge' WHEN s > 0 THEN 'up' WHEN s > -0.5 THEN 'down' ELSE 'stall' END AS trend FROM t)
"""
JOIN_SQL = "j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
HHI_SQL = """
party AS (SELECT c_mktsegment, o_custkey, count(*) AS n FROM j GROUP BY 1, 2),
hhi AS (SELECT c_mktsegment, sum(n * n) / pow(sum(n), 2) AS hhi FROM party GROUP BY 1),
band AS (SELECT c_mktsegment, hhi, CASE WHEN hhi < 0.10 THEN 'competitive' WHEN hhi < 0.18 THEN 'moderate' ELSE 'concentrated' END AS hhi_status FROM hhi)
"""


@query("rich_summary_stats", f"WITH {JOIN_SQL}, {TREND_SQL.format(by='c_mktsegment')}, {HHI_SQL} SELECT c_mktsegment, round(cagr, 6) AS cagr, round(slope, 6) AS slope, trend, round(hhi, 6) AS hhi, hhi_status FROM trend JOIN band USING (c_mktsegment)")
def rich_summary_stats(spark, sf_dir):
    """Growth, slope, trend and concentration of each market segment."""
    j = by_customer(spark, sf_dir)
    t = growth.trends(growth.yearly(j, F.col("o_orderdate"), "c_mktsegment"), "c_mktsegment")
    h = growth.concentration(j, "o_custkey", "c_mktsegment")
    return t.join(h, "c_mktsegment").select("c_mktsegment", F.round("cagr", 6).alias("cagr"), F.round("slope", 6).alias("slope"), "trend", F.round("hhi", 6).alias("hhi"), "hhi_status")


@query("hhi_by_segment", f"WITH {JOIN_SQL}, {HHI_SQL} SELECT c_mktsegment, round(hhi, 6) AS hhi, hhi_status FROM band")
def hhi_by_segment(spark, sf_dir):
    h = growth.concentration(by_customer(spark, sf_dir), "o_custkey", "c_mktsegment")
    return h.select("c_mktsegment", F.round("hhi", 6).alias("hhi"), "hhi_status")


@query("summary_text", f"WITH {JOIN_SQL}, {TREND_SQL.format(by='c_mktsegment')} SELECT c_mktsegment, c_mktsegment || ': ' || printf('%.1f%%', cagr * 100) || ' a year, ' || trend AS line FROM trend")
def summary_text(spark, sf_dir):
    """One line on each segment's growth."""
    from ..functions.text import percent

    t = growth.trends(growth.yearly(by_customer(spark, sf_dir), F.col("o_orderdate"), "c_mktsegment"), "c_mktsegment")
    return t.select("c_mktsegment", F.concat("c_mktsegment", F.lit(": "), percent(F.col("cagr")), F.lit(" a year, "), "trend").alias("line"))


@query("ts_counts", "SELECT c_mktsegment, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def ts_counts(spark, sf_dir):
    j = by_customer(spark, sf_dir)
    return j.groupBy("c_mktsegment", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("ts_filled", """WITH c AS (SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2),
y AS (SELECT o_custkey, unnest(range(min(year), max(year) + 1))::INT AS year FROM c GROUP BY 1)
SELECT o_custkey, year, coalesce(n, 0) AS n FROM y LEFT JOIN c USING (o_custkey, year)""")
def ts_filled(spark, sf_dir):
    """Orders of each customer by year, years without any between its first and last as 0."""
    return growth.with_empty_years(growth.yearly(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_custkey"), "o_custkey")


@query("top_applicants", "SELECT * FROM (SELECT c_mktsegment, o_custkey, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_custkey)::INT AS rank FROM (SELECT c_mktsegment, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE rank <= 10")
def top_applicants(spark, sf_dir):
    """The ten busiest customers of each segment."""
    n = by_customer(spark, sf_dir).groupBy("c_mktsegment", "o_custkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "o_custkey")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("treemap_rollup", "SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def treemap_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("lifecycle", "WITH a AS (SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS parties, count(*) AS n FROM orders GROUP BY 1) SELECT year, parties, n, parties - lag(parties) OVER (ORDER BY year) AS parties_change, n - lag(n) OVER (ORDER BY year) AS n_change FROM a")
def lifecycle(spark, sf_dir):
    return growth.lifecycle(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"))


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def crosstab(spark, sf_dir):
    """Orders by priority and status, a column for each status."""
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return t.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in "FOP"])


@query("pulse_quadrant", f"""WITH {JOIN_SQL}, {TREND_SQL.format(by='c_nationkey')},
a AS (SELECT c_nationkey, n, round(cagr, 6) AS cagr FROM trend JOIN (SELECT c_nationkey, sum(n)::BIGINT AS n FROM counts GROUP BY 1) USING (c_nationkey)),
m AS (SELECT quantile_cont(n, 0.5) AS mn, quantile_cont(cagr, 0.5) AS mc FROM a)
SELECT c_nationkey, n, cagr, CASE WHEN cagr >= mc AND n >= mn THEN 'leading' WHEN cagr >= mc THEN 'emerging' WHEN n >= mn THEN 'established' ELSE 'fading' END AS quadrant FROM a, m""")
def pulse_quadrant(spark, sf_dir):
    return growth.quadrants(growth.yearly(by_customer(spark, sf_dir), F.col("o_orderdate"), "c_nationkey"), "c_nationkey")


@query("trajectory", f"""WITH {JOIN_SQL}, counts AS (SELECT c_nationkey, year(o_orderdate)::INT AS year, count(*) AS n FROM j GROUP BY 1, 2)
SELECT c_nationkey, year, n, (sum(n) OVER w)::BIGINT AS total, round(n / lag(n) OVER w - 1, 6) AS growth FROM counts WINDOW w AS (PARTITION BY c_nationkey ORDER BY year)""")
def trajectory(spark, sf_dir):
    return growth.trajectory(growth.yearly(by_customer(spark, sf_dir), F.col("o_orderdate"), "c_nationkey"), "c_nationkey")


@query("portfolio", f"""WITH {JOIN_SQL} SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM j WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2""")
def portfolio(spark, sf_dir):
    """What one segment holds, by priority and status."""
    j = by_customer(spark, sf_dir).where(F.col("c_mktsegment") == "BUILDING")
    return j.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))
