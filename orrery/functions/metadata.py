"""Multi-valued bibliographic fields: classification codes, themes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc_lower, trim_unicode

# The formats of classification codes.
FULL_CODE = "([a-z]\\d{2}[a-z])\\s*(\\d{1,4}/\\d{2,})"
SUBCLASS = "\\b([a-z]\\d{2}[a-z])\\b"
BRACKETED = "[(（][^)]*[)）]"
THEME_LENGTH = 5
NAME_MARKS = "▲▼　"


def split_literal(c: Column, delimiter: str) -> Column:
    """Parts of ``c``; the delimiter is text, not a pattern. Null gives no parts."""
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.coalesce(F.split(c, quoted), F.array().cast("array<string>"))


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x != "")))


def ipc_codes(c: Column, delimiter: str = ";") -> Column:
    """Normalised codes in order, repeats kept: the full code without spaces, else the subclass; other parts are dropped."""
    text = F.regexp_replace(nfkc_lower(F.coalesce(c, F.lit(""))), BRACKETED, " ")

    def code(p):
        full = F.concat(F.regexp_extract(p, FULL_CODE, 1), F.regexp_extract(p, FULL_CODE, 2))
        return F.when(p.rlike(FULL_CODE), full).when(p.rlike(SUBCLASS), F.regexp_extract(p, SUBCLASS, 1))

    return F.filter(F.transform(split_literal(text, delimiter), lambda p: code(trim_unicode(p))), lambda x: x.isNotNull())


def ipc_main_groups(c: Column, delimiter: str = ";") -> Column:
    """Distinct upper-case texts before the first slash of each part."""
    return _set(F.transform(split_literal(c, delimiter), lambda p: F.upper(trim_unicode(F.split_part(trim_unicode(p), F.lit("/"), F.lit(1))))))


def fterm_themes(c: Column, delimiter: str = ";") -> Column:
    """Distinct themes: five characters of parts that have five before trimming."""
    parts = F.filter(split_literal(c, delimiter), lambda p: (trim_unicode(p) != "") & (F.length(p) >= THEME_LENGTH))
    return _set(F.transform(parts, lambda p: F.upper(F.substring(trim_unicode(p), 1, THEME_LENGTH))))


def name_list(c: Column, delimiter: str = ";") -> Column:
    """Distinct trimmed names."""
    return _set(F.transform(split_literal(c, delimiter), trim_unicode))


def inventor_list(c: Column, delimiter: str = ";") -> Column:
    """As name_list, without marks and ideographic spaces."""
    return name_list(F.translate(c, NAME_MARKS, ""), delimiter)
