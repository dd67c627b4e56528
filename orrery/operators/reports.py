"""Report texts as tables of blocks, and the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.text import bold_markup, trim_unicode

# The marks that report lines are read by.
RULE = "^[-*_]{3,}$"
EVIDENCE = "(?i)\\[\\[Evidence (\\d+)\\]\\]"
AROUND = "[、, \\t]+"
BULLET = "• "


def kind_of(line: Column) -> Column:
    """Kind of a trimmed line, first fitting rule."""
    return (
        F.when(line == "", "spacer").when(line.rlike(RULE), "rule").when(line.rlike(EVIDENCE), "evidence")
        .when(line.startswith("# "), "heading1").when(line.startswith("## "), "heading2").when(line.startswith("### "), "heading3").when(line.startswith("#### "), "strong")
        .when(line.startswith("- ") | line.startswith("* "), "bullet").otherwise("normal")
    )


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, content, page_break): the lines of each report.

    Headings of the first two levels start a page unless they are the first line.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line", trim_unicode(F.col("raw")))
    kind = kind_of(F.col("line"))
    mark = F.length(F.regexp_extract("line", "^(#{1,4} |[-*] )", 1))
    marked = trim_unicode(F.substring("line", mark + 1, F.length("line")))
    body = F.when(kind.isin("heading1", "heading2", "heading3", "strong", "bullet"), marked).when(kind.isin("rule", "spacer"), "").otherwise(F.col("line"))
    body = bold_markup(body)
    body = F.when(kind == "strong", F.concat(F.lit("<b>"), body, F.lit("</b>"))).when(kind == "bullet", F.concat(F.lit(BULLET), body)).otherwise(body)
    out = lines.select(key, "line_no", kind.alias("kind"), body.alias("content"))
    return out.withColumn("page_break", F.col("kind").isin("heading1", "heading2") & (F.col("line_no") > 0))


def evidence_refs(df: DataFrame, key: str, text: str, evidence: DataFrame) -> DataFrame:
    """(key, nth, ordinal, id): the evidence that a text cites, by place; numbers beyond the table are dropped.

    ``evidence`` has (ordinal, id), numbered from 1.
    """
    refs = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(EVIDENCE), 1)).alias("nth", "n")).select(key, "nth", F.expr("try_cast(n as bigint)").alias("ordinal"))
    return refs.join(evidence.select("ordinal", "id"), "ordinal").select(key, "nth", "ordinal", "id")


def text_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, part_no, content): the text around evidence marks in the lines that have any, without separators next to them.

    Lines are split and trimmed first; parts that are blank are left out.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).where(F.col("raw").rlike(EVIDENCE))
    parts = lines.select(key, "line_no", F.split(trim_unicode(F.col("raw")), EVIDENCE, -1).alias("p"))
    parts = parts.select(key, "line_no", F.size("p").alias("n"), F.posexplode("p").alias("part_no", "t"))
    right = F.when(F.col("part_no") < F.col("n") - 1, F.regexp_replace("t", AROUND + "$", "")).otherwise(F.col("t"))
    both = F.when(F.col("part_no") > 0, F.regexp_replace(right, "^" + AROUND, "")).otherwise(right)
    return parts.select(key, "line_no", "part_no", bold_markup(both).alias("content")).where(trim_unicode(F.col("content")) != "")


def append_new(log: DataFrame, snapshots: DataFrame, only_new: bool = False) -> DataFrame:
    """The log (ordinal, id, ...) with the snapshots whose id it doesn't have, all their fields, numbered on in the order of their ids.

    Ids may have any type that has an order. Of snapshots that share an id the
    one whose other fields come first counts. The same snapshots offered again
    change nothing. With ``only_new`` the result has the new rows alone.
    """
    rest = [c for c in snapshots.columns if c != "id"]
    fresh = snapshots.join(log.select("id"), "id", "left_anti")
    if rest:
        fresh = fresh.groupBy("id").agg(F.min(F.struct(*rest)).alias("__rest")).select("id", "__rest.*")
    else:
        fresh = fresh.distinct()
    last = log.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("last"))  # one row
    fresh = numbered(fresh, "id", "ordinal").join(F.broadcast(last)).withColumn("ordinal", F.col("ordinal") + F.col("last")).drop("last")
    return fresh if only_new else log.unionByName(fresh, allowMissingColumns=True)


def evidence_name(ordinal: Column) -> Column:
    """File name of a piece of evidence, as reports refer to it."""
    return F.concat(F.lit("Evidence "), ordinal.cast("string"), F.lit(".png"))
