"""Roles of a table's columns, found by keywords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that must be bound before analysis.
REQUIRED = ("title", "abstract", "claim", "app_num", "date", "applicant", "ipc")
OPTIONAL = ("inventor", "fterm", "status")
# Header keywords of each role, by priority.
KEYWORDS = {
    "title": ("発明の名称", "名称", "Title", "Title of Invention"),
    "abstract": ("要約", "要約(抄録)", "Abstract"),
    "claim": ("請求項", "Claim"),
    "app_num": ("出願番号", "Application Number", "App No"),
    "date": ("出願日", "出願日（遡及）", "Date", "Filing"),
    "applicant": ("出願人", "Applicant", "Assignee"),
    "ipc": ("国際特許分類", "国際特許分類(IPC)", "IPC", "Int. Cl"),
    "inventor": ("発明者", "Inventor"),
    "fterm": ("Fターム", "テーマコード", "F-Term"),
    "status": ("ステータス", "Status", "Legal Status", "法的状態"),
}


def match_column(current: str | None, options: list, keywords) -> int:
    """Place of the column for a role: the current one if it is there, else the first keyword's exact and then partial match, at last without regard to case; 0 for none."""
    if current is not None and current in options:
        return options.index(current)
    for fits in (lambda k, c: c == k, lambda k, c: k in c, lambda k, c: k.lower() in c.lower()):
        for k in keywords:
            for i, c in enumerate(options):
                if c is not None and fits(k, c):
                    return i
    return 0


@dataclass(frozen=True)
class ColumnMap:
    """Physical column of each role, and the delimiters of multi-valued ones."""

    roles: dict
    delimiters: dict

    @classmethod
    def bind(cls, columns: list[str], keywords: dict = KEYWORDS, chosen: dict | None = None, delimiter: str = ";") -> "ColumnMap":
        options = [None, *columns]
        roles = {r: options[match_column((chosen or {}).get(r), options, keywords.get(r, ()))] for r in (*REQUIRED, *OPTIONAL)}
        return cls(roles, {r: delimiter for r in ("applicant", "inventor", "ipc", "fterm")})

    def missing(self) -> list[str]:
        return [r for r in REQUIRED if self.roles.get(r) is None]

    def project(self, df: DataFrame) -> DataFrame:
        """The bound columns under their roles' names; error where a required role is unbound."""
        if gaps := self.missing():
            raise ValueError(f"no column for: {', '.join(gaps)}")
        return df.select(*[F.col(c).alias(r) for r, c in self.roles.items() if c is not None])


def rank_matches(keywords: DataFrame, columns: DataFrame) -> DataFrame:
    """The best column of each role as a query.

    ``keywords`` (role, keyword, kw_pos) and ``columns`` (column, col_pos) are
    metadata: as many rows as roles have keywords and the table has columns.
    """
    hit = F.broadcast(keywords).join(columns, F.contains(F.col("column"), F.col("keyword")))
    key = F.struct((F.col("column") != F.col("keyword")).alias("partial"), "kw_pos", "col_pos", "column")
    return hit.groupBy("role").agg(F.min(key)["column"].alias("column"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, distinct_n): values that aren't null, and distinct ones, of each column, in one pass over them."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*")
    # Counted by value first, so that a column is no one task's.
    counts = values.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_n"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("distinct_n", F.lit(0)).alias("distinct_n"))
