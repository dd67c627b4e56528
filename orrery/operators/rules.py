"""Search rules as data, and an index of places that answers them without reading texts.

A rule is a word, or a dict of one kind (JSON serves as their text form):

- ``{"phrase": [words]}``: the words in a row
- ``{"all": [rules]}``, ``{"any": [rules]}``, ``{"not": rule}``
- ``{"near": [x, y], "within": n}``: at most n words apart, in any order
- ``{"adjacent": [x, y], "within": n}``: y begins after x by at most n words

x and y are words, phrases, or ``any`` of these. A rule that is none of these
is refused with the path to what is wrong.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index; a rule reads those of its own words.
BUCKETS = 64
#: What splits the rows of a frequent word while an index is written.
SALTS = 16


class RuleError(ValueError):
    """What is wrong with a rule, and where."""


def read_rule(text: str):
    """The rule that a JSON text holds."""
    try:
        rule = json.loads(text)
    except json.JSONDecodeError as e:
        raise RuleError(f"line {e.lineno}, column {e.colno}: {e.msg}") from None
    words(rule)
    return rule


def _kind(rule, path: str) -> tuple[str, object, int]:
    """(kind, operands, within) of a rule, checked one level deep."""
    if isinstance(rule, str):
        if not rule:
            raise RuleError(f"{path}: an empty word")
        return "word", rule, 0
    if not isinstance(rule, dict):
        raise RuleError(f"{path}: neither a word nor a dict")
    names = set(rule) - {"within"}
    if len(names) != 1 or not names <= {"phrase", "all", "any", "not", "near", "adjacent"}:
        raise RuleError(f"{path}: one of phrase, all, any, not, near, adjacent is due, not {', '.join(sorted(map(str, names))) or 'nothing'}")
    kind = names.pop()
    value, far = rule[kind], rule.get("within", 1)
    if kind in ("near", "adjacent"):
        if not isinstance(value, list) or len(value) != 2:
            raise RuleError(f"{path}.{kind}: two operands are due")
        if not isinstance(far, int) or isinstance(far, bool) or far < 1:
            raise RuleError(f"{path}.within: a whole number from 1 is due")
    elif "within" in rule:
        raise RuleError(f"{path}.within: only near and adjacent have a distance")
    elif kind != "not" and (not isinstance(value, list) or not value):
        raise RuleError(f"{path}.{kind}: a list that isn't empty is due")
    elif kind == "phrase" and not all(isinstance(w, str) and w for w in value):
        raise RuleError(f"{path}.phrase: words are due")
    return kind, value, far


def words(rule, path: str = "$", placed: bool = False) -> set[str]:
    """The words that a rule names; an error if it isn't a rule. ``placed``: it stands where places are due."""
    kind, value, _ = _kind(rule, path)
    if kind == "word":
        return {value}
    if kind == "phrase":
        return set(value)
    if placed and kind != "any":
        raise RuleError(f"{path}: a word, a phrase or any of these is due")
    parts = [(value, f"{path}.not")] if kind == "not" else [(r, f"{path}.{kind}[{i}]") for i, r in enumerate(value)]
    return set().union(*(words(r, p, placed or kind in ("near", "adjacent")) for r, p in parts))


def _followed(hits: Column, own: Column, k: int) -> Column:
    """The places among ``hits`` that have one of ``own`` k words later."""
    return F.filter(hits, lambda x: F.array_contains(own, x + k))


def _spans(rule, places) -> Column:
    """array<struct<s, e>>: first and last place of each hit of a word, a phrase or any of these."""
    kind, value, _ = _kind(rule, "$")
    if kind == "word":
        return F.transform(places(value), lambda x: F.struct(x.alias("s"), x.alias("e")))
    if kind == "any":
        return F.flatten(F.array(*[_spans(r, places) for r in value]))
    hits = places(value[0])
    for k, w in enumerate(value[1:], 1):
        hits = _followed(hits, places(w), k)
    return F.transform(hits, lambda x: F.struct(x.alias("s"), (x + (len(value) - 1)).alias("e")))


def condition(rule, places) -> Column:
    """The rule as a condition; ``places`` gives the places of a word, an array of ints, as a Column."""
    kind, value, far = _kind(rule, "$")
    if kind == "all" or kind == "any":
        out = condition(value[0], places)
        for r in value[1:]:
            out = out & condition(r, places) if kind == "all" else out | condition(r, places)
        return out
    if kind == "not":
        return ~condition(value, places)
    if kind in ("word", "phrase"):
        return F.size(_spans(rule, places)) > 0
    a, b = (_spans(r, places) for r in value)
    if kind == "adjacent":
        fits = lambda x, y: (y["s"] > x["e"]) & (y["s"] - x["e"] <= far)
    else:
        fits = lambda x, y: ((y["s"] > x["e"]) & (y["s"] - x["e"] <= far)) | ((x["s"] > y["e"]) & (x["s"] - y["e"] <= far))
    # b is worked out once for a row, not once for each of a's places.
    return F.exists(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.exists(p["a"], lambda x: F.exists(p["b"], lambda y: fits(x, y)))), lambda x: x)


def matches(toks: Column, rule) -> Column:
    """The rule as a condition on an array of words."""
    words(rule)
    return condition(rule, lambda w: F.filter(F.transform(toks, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull()))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(df: DataFrame, key: str, toks: Column, path: str) -> None:
    """Write the places of every word of every row: (term, key, at), in folders by a hash of the word and sorted by it.

    A row's places of a word are gathered where the row is, so only one array
    for each is shuffled; the rows of a frequent word are dealt over tasks.
    """
    each = df.select(F.col(key).alias("key"), F.posexplode(toks).alias("at", "term"))
    rows = each.groupBy("key", "term").agg(F.sort_array(F.collect_list("at")).alias("at"))
    rows = rows.withColumns({"bucket": _bucket(F.col("term")), "salt": F.pmod(F.xxhash64("key"), F.lit(SALTS))})
    rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "term").drop("salt").write.partitionBy("bucket").parquet(f"{path}/places")
    df.select(F.col(key).alias("key")).write.parquet(f"{path}/keys")


def search(spark: SparkSession, path: str, rule) -> DataFrame:
    """(key) of the rows that a rule fits, from an index: only the folders of the rule's words are read.

    Where a row without any of the words fits too, such as under ``not``, the
    keys of all rows are read besides.
    """
    named = sorted(words(rule))
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in named], "w string").select(_bucket(F.col("w"))).distinct().collect()]
    rows = spark.read.parquet(f"{path}/places").where(F.col("bucket").isin(buckets) & F.col("term").isin(named))
    found = rows.groupBy("key").agg(*[F.first(F.when(F.col("term") == w, F.col("at")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(named)])
    at = {w: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, w in enumerate(named)}
    fits = condition(rule, at.__getitem__)
    if not holds_without(rule):
        return found.where(fits).select("key")
    return spark.read.parquet(f"{path}/keys").join(found.where(~fits).select("key"), "key", "left_anti").select("key")


def holds_without(rule) -> bool:
    """Whether a row that has none of a rule's words fits."""
    kind, value, _ = _kind(rule, "$")
    if kind in ("all", "any"):
        return (all if kind == "all" else any)(holds_without(r) for r in value)
    return kind == "not" and not holds_without(value)
