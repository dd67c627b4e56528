"""Rules as data against a plain reading of them, by scan and by index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import rules


def spans(rule, toks):
    if isinstance(rule, str):
        return [(i, i) for i, t in enumerate(toks) if t == rule]
    if "any" in rule:
        return [x for r in rule["any"] for x in spans(r, toks)]
    p = rule["phrase"]
    return [(i, i + len(p) - 1) for i in range(len(toks)) if toks[i : i + len(p)] == p]


def holds(rule, toks):
    if isinstance(rule, str) or "phrase" in rule:
        return bool(spans(rule, toks))
    if "all" in rule:
        return all(holds(r, toks) for r in rule["all"])
    if "any" in rule:
        return any(holds(r, toks) for r in rule["any"])
    if "not" in rule:
        return not holds(rule["not"], toks)
    near = "near" in rule
    a, b = (spans(r, toks) for r in rule["near" if near else "adjacent"])
    n = rule.get("within", 1)
    return any(0 < y[0] - x[1] <= n or (near and 0 < x[0] - y[1] <= n) for x in a for y in b)


def made(g, depth=3):
    word = lambda: g.choice("abcdef")
    placed = lambda: g.choice([word(), word(), {"phrase": [word(), word()]}, {"any": [word(), {"phrase": [word(), word(), word()]}]}])
    kind = g.choice(["word", "phrase", "near", "adjacent"] + (["all", "any", "not"] * 2 if depth else []))
    if kind == "word":
        return word()
    if kind == "phrase":
        return {"phrase": [word() for _ in range(g.randrange(1, 4))]}
    if kind == "not":
        return {"not": made(g, depth - 1)}
    if kind in ("all", "any"):
        return {kind: [made(g, depth - 1) for _ in range(g.randrange(1, 4))]}
    return {kind: [placed(), placed()], "within": g.randrange(1, 4)}


def test_rules_by_scan_and_by_index(spark, tmp_path):
    g = random.Random(3)
    docs = [(i, [g.choice("abcdefgh") for _ in range(g.randrange(0, 12))]) for i in range(120)] + [(200, None)]
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    rules.write_index(df, "id", F.col("toks"), str(tmp_path / "index"))
    for _ in range(12):
        rule = rules.read_rule(json.dumps(made(g)))
        want = sorted(i for i, t in docs if holds(rule, t or []))
        scan = df.where(rules.matches(F.coalesce("toks", F.array().cast("array<string>")), rule)).select("id")
        assert sorted(r[0] for r in scan.collect()) == want, rule
        assert sorted(r[0] for r in rules.search(spark, str(tmp_path / "index"), rule).collect()) == want, rule


def test_an_index_reads_its_words_folders_only(spark, tmp_path):
    df = spark.createDataFrame([(i, [f"w{i % 50}", "common", f"x{i}"]) for i in range(300)], "id long, toks array<string>")
    rules.write_index(df, "id", F.col("toks"), str(tmp_path / "index"))
    found = rules.search(spark, str(tmp_path / "index"), {"adjacent": ["w7", "common"]})
    plan = found._jdf.queryExecution().toString()
    assert sorted(r[0] for r in found.collect()) == [i for i in range(300) if i % 50 == 7]
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "keys" not in plan and "toks" not in plan


@pytest.mark.parametrize("rule, where", [
    ("", "$: an empty"), (5, "$: neither"), ({"all": []}, "$.all: a list"), ({"all": ["a", {"nor": ["b"]}]}, "$.all[1]: one of"), ({"near": ["a"], "within": 2}, "$.near: two"),
    ({"near": ["a", "b"], "within": 0}, "$.within: a whole"), ({"not": {"phrase": ["a", 1]}}, "$.not.phrase: words"), ({"adjacent": ["a", {"not": "b"}]}, "$.adjacent[1]: a word"), ({"any": ["a"], "within": 2}, "$.within: only"), ({}, "$: one of"),
])
def test_what_is_wrong_has_its_place(rule, where):
    with pytest.raises(rules.RuleError) as e:
        rules.read_rule(json.dumps(rule))
    assert str(e.value).startswith(where)


def test_text_that_is_no_json_has_its_place():
    with pytest.raises(rules.RuleError, match="line 1, column 9"):
        rules.read_rule('{"all": ]')
