"""Boolean and positional conditions on token arrays, and keywords in context.

Conditions are Columns: combine them with &, | and ~.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(toks: Column, term: str) -> Column:
    return F.array_contains(toks, term)


def places(toks: Column, term: str) -> Column:
    """Positions of a term, from 0."""
    return F.filter(F.transform(toks, lambda t, i: F.when(t == term, i)), lambda i: i.isNotNull())


def _pair(toks: Column, a: str, b: str, fits) -> Column:
    return F.exists(F.transform(F.array(F.struct(places(toks, a).alias("a"), places(toks, b).alias("b"))), lambda p: F.exists(p["a"], lambda x: F.exists(p["b"], lambda y: fits(x, y)))), lambda x: x)


def near(toks: Column, a: str, b: str, n: int) -> Column:
    """a and b at most n words apart, in any order."""
    return _pair(toks, a, b, lambda x, y: (x != y) & (F.abs(x - y) <= n))


def adjacent(toks: Column, a: str, b: str, n: int = 1) -> Column:
    """b follows a by at most n words."""
    return _pair(toks, a, b, lambda x, y: (y - x >= 1) & (y - x <= n))


def kwic(df: DataFrame, key: str, toks: Column, term: str, width: int = 3) -> DataFrame:
    """(key, at, before, after): each hit with ``width`` words on either side."""
    t = df.select(key, toks.alias("t")).where(F.array_contains("t", term))
    t = t.select(key, "t", F.explode(places(F.col("t"), term)).alias("at"))
    return t.select(key, "at", F.array_join(F.slice("t", F.greatest(F.col("at") - width, F.lit(0)) + 1, F.least(F.col("at"), F.lit(width))), " ").alias("before"), F.array_join(F.slice("t", F.col("at") + 2, F.lit(width)), " ").alias("after"))
