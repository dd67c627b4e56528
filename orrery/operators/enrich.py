"""The analysis table: roles bound, dates parsed, fields split, text ready for terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions import text as tx
from ..functions.dates import DateParser
from .schema import ColumnMap


def clean_text(c):
    """Normal form for tokens: NFKC and lower case, no parenthesised words, figure numbers or punctuation."""
    return tx.strip_punctuation(tx.strip_figure_references(tx.strip_parenthesised(tx.nfkc_lower(c))))


def enrich(df: DataFrame, roles: ColumnMap, dates: DateParser | None = None) -> DataFrame:
    """Original columns, and parsed_date, year, app_num_main, the multi-valued fields and text_for_tfidf.

    The date vote is one aggregate; all else is one narrow projection. Unmapped
    optional fields give empty arrays.
    """
    if gaps := roles.missing():
        raise ValueError(f"no column for: {', '.join(gaps)}")
    r, d = roles.roles, roles.delimiters
    dates = dates or DateParser.fit(df, r["date"])
    none = F.array().cast("array<string>")
    by = lambda role, f: f(F.col(r[role]), d[role]) if r.get(role) in df.columns else none
    parsed = dates.transform(F.col(r["date"]))
    return df.withColumns({
        "text_for_tfidf": clean_text(tx.concat_fields(F.col(r["title"]), F.col(r["abstract"]), F.col(r["claim"]))),
        "parsed_date": parsed,
        "year": F.year(parsed),
        "app_num_main": tx.trim_unicode(F.col(r["app_num"]).cast("string")),
        "ipc_normalized": by("ipc", metadata.ipc_codes),
        "ipc_main_group": by("ipc", metadata.ipc_main_groups),
        "fterm_main": by("fterm", metadata.fterm_themes),
        "applicant_main": by("applicant", metadata.name_list),
        "inventor_main": by("inventor", metadata.inventor_list),
    })
