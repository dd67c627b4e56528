"""Stopword tables (one column, word): defaults, edits, search and width expansion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import full_width, trim_unicode

#: Default lists of our own by language, for words that carry no topic; projects bring their tables.
BY_LANGUAGE = {
    "en": "a an and are as at be been by can for from had has have if in into is it its may more not of on one or other over said same such than that the their them there these they this those to under upon was were when where wherein whereby which while will with",
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer eines es im in ist mit nach nicht oder sich sie sind und von vom wird werden wie zu zum zur",
    "fr": "au aux avec ce ces cette dans de des dont du elle en est et il la le les leur ne ou par pas pour que qui sa se ses son sont sur un une",
    "es": "al como con de del el en entre es esta este la las lo los no o para pero por que se sin son su sus un una y",
    # Words of patent texts and business reports, in English.
    "domain": "apparatus claim claims comprising configured device embodiment embodiments example figure first includes including invention means method plurality preferably present second system thereof",
}
DEFAULTS = tuple(sorted({w for words in BY_LANGUAGE.values() for w in words.split()}))


def defaults(spark: SparkSession, *languages: str) -> DataFrame:
    """(word) of the default lists of some languages (keys of BY_LANGUAGE), or of all."""
    words = sorted({w for k in languages for w in BY_LANGUAGE[k].split()}) if languages else DEFAULTS
    return spark.createDataFrame([(w,) for w in words], "word string")


def expand_width(words: DataFrame) -> DataFrame:
    """The words, and the full-width form of those with ASCII letters or digits."""
    wide = words.where(F.col("word").rlike("[A-Za-z0-9]")).select(full_width(F.col("word")).alias("word"))
    return words.select("word").union(wide).distinct()


def search(words: DataFrame, pattern: str) -> DataFrame:
    """Words that the pattern finds, or that contain it where it is no valid pattern."""
    try:
        re.compile(pattern)
    except re.error:
        return words.where(F.contains("word", F.lit(pattern)))
    return words.where(F.col("word").rlike(pattern))


def edit(current: DataFrame, matches: DataFrame, edited: DataFrame) -> DataFrame:
    """(word, change): the new set after the matches shown were edited, and what went.

    Change is "kept", "added" or "removed"; the new set is all but the removed.
    """
    removed, added = matches.select("word").subtract(edited.select("word")), edited.select("word").subtract(matches.select("word"))
    kept = current.select("word").subtract(removed).subtract(added)
    mark = lambda df, m: df.withColumn("change", F.lit(m))
    return mark(kept, "kept").union(mark(added, "added")).union(mark(removed.intersect(current.select("word")), "removed"))


def counts(edited: DataFrame) -> DataFrame:
    """(added, removed, total): one row of counts for an edit."""
    n = lambda cond: F.count(F.when(cond, 1))
    return edited.agg(n(F.col("change") == "added").alias("added"), n(F.col("change") == "removed").alias("removed"), n(F.col("change") != "removed").alias("total"))


def replace(current: DataFrame, edited: DataFrame) -> DataFrame:
    """(word, change): the whole list replaced by the edited one."""
    return edit(current, current, edited)


def imported(current: DataFrame, lines: DataFrame) -> DataFrame:
    """(word, change): the list with the words of a file's lines (column value) put in; none goes."""
    return edit(current, current.limit(0), from_lines(lines).join(current, "word", "left_anti"))


def reset(current: DataFrame) -> DataFrame:
    """(word, change): back to the default list."""
    return replace(current, defaults(current.sparkSession))


def from_lines(lines: DataFrame) -> DataFrame:
    """Trimmed, distinct words of a text file's lines (column value)."""
    return lines.select(trim_unicode(F.col("value")).alias("word")).where("word <> ''").distinct()


def export(words: DataFrame, path: str) -> None:
    """One word a line, sorted."""
    words.select("word").distinct().orderBy("word").write.text(path)
