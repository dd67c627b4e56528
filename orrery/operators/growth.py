"""Growth and concentration of yearly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the labels.
SURGE, STALL = 0.5, -0.5
COMPETITIVE, MODERATE = 0.10, 0.18


def yearly(df: DataFrame, when: Column, *by: str) -> DataFrame:
    """(by..., year, n): rows per year; rows without a date are left out and years without rows are absent."""
    return df.where(when.isNotNull()).groupBy(*by, F.year(when).alias("year")).agg(F.count("*").alias("n"))


def trends(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., cagr, slope, trend) from yearly counts.

    The slope is the regression of count on year over all years; growth
    compares the last year with the first. With one year both are 0 and the
    trend is "stable"; without any all three are null.
    """
    span = F.greatest(F.lit(1), F.max("year") - F.min("year"))
    first, last = F.min_by("n", "year"), F.max_by("n", "year")
    a = counts.groupBy(*by).agg(F.count("*").alias("years"), F.regr_slope("n", "year").alias("s"), (F.pow(last / F.when(first > 0, first).otherwise(1), 1.0 / span) - 1).alias("g"))
    many = F.col("years") >= 2
    s = F.when(many, F.col("s")).when(F.col("years") == 1, 0.0)
    one = F.col("years") == 1
    label = F.when(one, "stable").when(s > SURGE, "surge").when(s > 0, "up").when(s > STALL, "down").when(many, "stall")
    return a.select(*by, F.when(many, F.col("g")).when(one, 0.0).alias("cagr"), s.alias("slope"), label.alias("trend"))


def concentration(df: DataFrame, party: str, *by: str) -> DataFrame:
    """(by..., hhi, hhi_status): sum of squared shares of the parties' counts; 0 and "no data" where there is none."""
    counts = df.groupBy(*by, party).agg(F.count("*").alias("n"))
    h = counts.groupBy(*by).agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"))
    none = F.col("hhi").isNull()
    return h.select(*by, F.coalesce("hhi", F.lit(0.0)).alias("hhi"), F.when(none, "no data").when(F.col("hhi") < COMPETITIVE, "competitive").when(F.col("hhi") < MODERATE, "moderate").otherwise("concentrated").alias("hhi_status"))


def with_empty_years(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., year, n): the counts, and 0 for the years of a group between its first and last that have none."""
    span = counts.groupBy(*by).agg(F.sequence(F.min("year"), F.max("year")).alias("years"), F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("found"))
    # A group's rows are its years: few.
    return span.select(*by, F.explode("years").alias("year"), "found").select(*by, "year", F.coalesce(F.try_element_at("found", F.col("year")), F.lit(0)).alias("n"))


def count_values(df: DataFrame, values: str, *by: str) -> DataFrame:
    """(by..., value, n): full counting, a row counts once for each of its values."""
    return df.select(*by, F.explode(values).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))


def lifecycle(df: DataFrame, party: str, when: Column) -> DataFrame:
    """(year, parties, n, parties_change, n_change) year by year."""
    a = df.groupBy(F.year(when).alias("year")).agg(F.countDistinct(party).alias("parties"), F.count("*").alias("n"))
    w = Window.orderBy("year")  # one row a year
    return a.select("year", "parties", "n", (F.col("parties") - F.lag("parties").over(w)).alias("parties_change"), (F.col("n") - F.lag("n").over(w)).alias("n_change"))


def quadrants(counts: DataFrame, key: str) -> DataFrame:
    """(key, n, cagr, quadrant): growth and volume, each split at its median."""
    a = trends(counts, key).join(counts.groupBy(key).agg(F.sum("n").alias("n")), key).select(key, "n", F.round("cagr", 6).alias("cagr"))
    middle = a.agg(F.percentile("n", F.lit(0.5)).alias("mn"), F.percentile("cagr", F.lit(0.5)).alias("mc"))
    name = F.when((F.col("cagr") >= F.col("mc")) & (F.col("n") >= F.col("mn")), "leading").when(F.col("cagr") >= F.col("mc"), "emerging").when(F.col("n") >= F.col("mn"), "established").otherwise("fading")
    return a.join(F.broadcast(middle)).select(key, "n", "cagr", name.alias("quadrant"))  # one row of medians


def trajectory(counts: DataFrame, key: str) -> DataFrame:
    """(key, year, n, total, growth): running total and year-on-year growth of each player."""
    w = Window.partitionBy(key).orderBy("year")
    return counts.select(key, "year", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.round(F.col("n") / F.lag("n").over(w) - 1, 6).alias("growth"))
