"""Column expressions for text: all native but Unicode NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The patterns that results depend on.
# (?U) makes \w, \s, \d and \b follow Unicode.
PARENTHESISED = "(?U)[(（][\\w\\s]+[)）]"
FIGURE_REFERENCE = "(?U)\\b(図|fig|step|s)\\s?\\d+\\b"
ASCII_PUNCTUATION = "[!-/:-@\\[-`{-~]"
UNICODE_EDGES = "(?U)^\\s+|\\s+$"
TAG = "<[^>]+>"
BOLD = "\\*\\*(.*?)\\*\\*"
TOKEN = "[\\p{L}\\p{N}_]{2,}"
ASCII_ONLY = "^[\\x00-\\x7F]*$"
#: Strings that readers take as missing (the defaults of pandas).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, also where f uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc_lower(c: Column) -> Column:
    """NFKC, then lower case. Only texts beyond ASCII travel to Python."""
    ascii_ = c.rlike(ASCII_ONLY)
    return F.lower(F.when(ascii_, c).otherwise(_nfkc(F.when(~ascii_, c))))


def concat_fields(*cols: Column) -> Column:
    """Fields joined by single spaces, a missing one as an empty string (concat_ws would lose its space)."""
    out = [F.coalesce(c, F.lit("")) for c in cols]
    return F.concat(*[x for c in out for x in (c, F.lit(" "))][:-1])


def strip_parenthesised(c: Column) -> Column:
    return F.regexp_replace(c, PARENTHESISED, " ")


def strip_figure_references(c: Column) -> Column:
    return F.regexp_replace(c, FIGURE_REFERENCE, " ")


def strip_punctuation(c: Column, compat: bool = False) -> Column:
    """ASCII punctuation to spaces; ``compat`` blanks only the three characters that the pattern in use reaches."""
    return F.regexp_replace(c, "\\}~\\]" if compat else ASCII_PUNCTUATION, " ")


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE_EDGES, "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def bold_markup(c: Column) -> Column:
    return F.regexp_replace(c, BOLD, "<b>$1</b>")


def flatten_snippet(c: Column, n: int = 200) -> Column:
    """Line breaks to spaces, the first n characters, and an ellipsis in any case."""
    return F.concat(F.substring(F.translate(c, "\n", " "), 1, n), F.lit("..."))


def shorten(c: Column, n: int = 30) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def null_if_missing(c: Column) -> Column:
    return F.when(c.isin(*MISSING), None).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-case tokens of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c * 100)).otherwise("N/A")


def stamp(c: Column) -> Column:
    """Date and time of a saved record."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def long_date(c: Column) -> Column:
    """Date of a report's title page."""
    return F.date_format(c, "MMMM dd, yyyy")


def listed_names(c: Column) -> Column:
    """Names of an array in one string, without missing ones; null without an array."""
    kept = F.filter(c, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))
    return F.array_join(F.transform(kept, trim_unicode), ", ")


def full_width(c: Column) -> Column:
    """ASCII letters and digits as their full-width forms."""
    ascii_ = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    return F.translate(c, ascii_, "".join(chr(ord(x) + 0xFEE0) for x in ascii_))


def noun_compounds(toks: Column, stopwords: list[str]) -> Column:
    """Fold tokens (array of struct base, pos) to nouns and compounds of two.

    Left to right: a token that is a stopword or shorter than two characters
    is skipped; two nouns in a row, the second no stopword, become one word;
    any other noun stands for itself. Stopwords part their neighbours.
    """
    return F.coalesce(let(toks, lambda t: _fold_nouns(t, F.array(*[F.lit(w) for w in stopwords]).cast("array<string>"))), F.lit(""))


def _fold_nouns(toks: Column, stop: Column) -> Column:
    word = lambda t: ~F.array_contains(stop, t["base"])
    noun = lambda t: t["pos"] == "noun"
    alone = lambda t: word(t) & (F.length(t["base"]) >= 2) & noun(t)
    # A mark a token: 1 where it could begin a pair. Read from the left, a pair takes the mark after it as well.
    starts = F.transform(toks, lambda t, i: F.when(alone(t) & noun(F.get(toks, i + 1)) & word(F.get(toks, i + 1)), "1").otherwise("0"))
    marks = F.split(F.regexp_replace(F.array_join(starts, ""), "1.", "PS"), "")

    def put(t, i, mark):
        return F.when(mark == "P", F.concat(t["base"], F.get(toks, i + 1)["base"])).when((mark != "S") & alone(t), t["base"])

    return let(marks, lambda m: F.array_join(F.transform(toks, lambda t, i: put(t, i, F.get(m, i))), " "))
