"""Readers for delimited tables with any headers, word lists and spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_if_missing

FALLBACK = "Shift_JIS"


def verdicts(spark: SparkSession, path: str) -> dict[str, bool]:
    """The files under a path, and whether each line of theirs is UTF-8: one pass, and one row a file for the driver, which lists the files anyway.

    Spark itself replaces malformed bytes without a word. A file without lines isn't listed.
    """
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.min(F.is_valid_utf8("value")).alias("ok"))
    return {r["file"]: r["ok"] for r in lines.collect()}


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as strings, missing markers as null; a file that is no UTF-8 is read as Shift_JIS, each for itself.

    Quotes inside quoted fields are doubled, and fields may span lines. The
    fallback needs spark.sql.legacy.javaCharsets when the rows are read, so it
    is set for the session and stays. Files under one path have one header.
    """
    found = {} if encoding else verdicts(spark, path)
    own, other = ([f for f in sorted(found) if found[f] is ok] for ok in (True, False))
    if other or encoding not in (None, "UTF-8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")

    def read(paths, charset: str) -> DataFrame:
        return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", charset).csv(paths)

    parts = [read(path, encoding or "UTF-8")] if not other else [*([read(own, "UTF-8")] if own else []), read(other, FALLBACK)]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return df.select(*[null_if_missing(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines of text files (column word)."""
    from ..operators.stopwords import from_lines

    return from_lines(spark.read.text(path))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook, all strings. Needs openpyxl; a workbook is small by its format (2^20 rows)."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))
    return df.select(*[null_if_missing(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix, upper or lower case: .csv, or else a workbook."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_excel(spark, path)


def publish(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Offer a table to SQL under a name, written to ``path`` first if given."""
    if path:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df
