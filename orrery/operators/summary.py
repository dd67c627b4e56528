"""Rich summaries of groups of documents: growth, concentration and representative lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_snippet, listed_names, percent, shorten
from . import growth, vectors

# The texts that stand for missing fields.
NO_TITLE, NO_ABSTRACT, UNKNOWN = "No Title", "No Abstract", "N/A"


def missing(c: Column) -> Column:
    return c.isNull() | c.isin("", "nan")


def representative_line(title: Column, abstract: Column, year: Column, party: Column) -> Column:
    """One document as a line: title, year, applicants and the beginning of its abstract."""
    a, b = F.when(missing(title), NO_TITLE).otherwise(title), F.when(missing(abstract), NO_ABSTRACT).otherwise(abstract)
    year, party = (F.coalesce(c.cast("string"), F.lit(UNKNOWN)) for c in (year, party))
    return F.concat(F.lit("- 【"), F.translate(a, "\n", " "), F.lit("】 ("), year, F.lit(", "), shorten(party), F.lit(") "), flatten_snippet(b))


def representative_lines(df: DataFrame, by: str, key: str, vector: str, title: str, abstract: str, year: str, parties: str, top: int = 5) -> DataFrame:
    """(by, representatives): lines of the rows nearest to the group's centroid, nearest first.

    A group's list is empty if over half of its lines have neither a title nor
    an abstract.
    """
    near = vectors.representatives(df, by, key, vector, top).select(by, key, "rank")
    rows = near.join(df.select(by, key, title, abstract, year, parties), [by, key])
    line = representative_line(F.col(title), F.col(abstract), F.col(year), listed_names(F.col(parties)))
    rows = rows.select(by, "rank", line.alias("line"), (missing(F.col(title)) & missing(F.col(abstract))).cast("int").alias("bad"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return rows.groupBy(by).agg(F.when(F.avg("bad") > 0.5, F.array().cast("array<string>")).otherwise(lines).alias("representatives"))


def rich_summary(df: DataFrame, by: str, key: str, vector: str, title: str, abstract: str, year: str, parties: str, top: int = 5) -> DataFrame:
    """(by, cagr, trend, hhi, hhi_status, representatives), one row a group.

    Growth is text in percent, "N/A" where the group has no years; parties is
    an array, of which each value counts.
    """
    counts = df.where(F.col(year).isNotNull()).groupBy(by, F.col(year).alias("year")).agg(F.count("*").alias("n"))
    trends = growth.trends(counts, by)
    shares = growth.concentration(df.select(by, F.explode(parties).alias("party")), "party", by)
    lines = representative_lines(df, by, key, vector, title, abstract, year, parties, top)
    # One row a group in each.
    every = df.select(by).distinct().join(trends, by, "left").join(shares, by, "left").join(lines, by, "left")
    return every.select(
        by, percent(F.col("cagr")).alias("cagr"), F.coalesce("trend", F.lit(UNKNOWN)).alias("trend"), F.round(F.coalesce("hhi", F.lit(0.0)), 6).alias("hhi"),
        F.coalesce("hhi_status", F.lit("no data")).alias("hhi_status"), F.coalesce("representatives", F.array().cast("array<string>")).alias("representatives"),
    )
