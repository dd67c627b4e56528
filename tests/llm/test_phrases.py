"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import phrases
from orrery.llm.common import store


def plain(rows, least, most=2000):
    """The contract, word by word, from (text, lang) pairs."""
    counts, every = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            every[lang] += len(ws)
            for m in range(1, 6):
                counts.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    best = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = []
            for k in range(1, len(p)):
                left, right = counts[lang, p[:k]], counts[lang, p[k:]]
                cuts.append((1000 * a * every[lang] // (left * right), k, left, right))
            best[lang, p] = a, min(cuts)
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), (a, (score, _, left, right)) in best.items():
        if not any(o == lang and len(q) > len(p) and 100 * best[o, q][0] >= 100 * a and inside(p, q) for o, q in best):
            out.append((lang, " ".join(p), a, left, right, every[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:most])]
    return sorted(ranked)


def texts(seed, n):
    g = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "日本", "x\x01", "x", "end\x00", "b-c"]
    made = []
    for _ in range(n):
        ws = g.choices(vocabulary, [9, 3, 5, 3, 2, 1, 1, 1, 1, 1], k=g.randrange(0, 40))
        made.append("".join(w + g.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", "\x0b"]) for w in ws))
    return [(t, g.choice(["en", "en", "en", "de", None, "und", ""])) for t in made] + [(None, "en"), ("", None), (" \t\n", "en"), (". , ;", "en")]


@pytest.mark.parametrize("least, most", [(2, 2000), (5, 2000), (30, 2000), (3, 7)])
def test_brute_force(spark, least, most):
    """Counts, cuts, left-out phrases and ranks, over more streams than languages, with words below a space in byte order."""
    rows = texts(least, 150)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("words", "c", "n", "l", "r", "a", "score", "k", "key", "rank", "w1")}).repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, least, most).collect()))
    assert got == plain(rows, least, most)


def test_one_phrase_everywhere(spark):
    """A passage that a third of all rows repeat lies across many streams of the sorted counts."""
    rows = [("over and over and over again we go", "en")] * 200 + [(f"w{i % 7} over and w{i % 3} again", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = sorted(map(tuple, phrases.collocations(docs, 50).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows, 50)


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def test_pair_map_is_a_superset(spark):
    """The map only ever lets too much through: counts are the same where it holds everything."""
    rows = texts(1, 100)
    docs = spark.createDataFrame(rows, "text string, lang string")
    full = lambda pairs: phrases.np.full(phrases.MAP_BITS // 64, phrases.np.uint64((1 << 64) - 1))
    want = sorted(map(str, phrases.frequent(docs, 10)[0].collect()))
    kept, phrases.pair_map = phrases.pair_map, full
    try:
        got = sorted(map(str, store(phrases.frequent(docs, 10)[0], "all").collect()))
    finally:
        phrases.pair_map = kept
    assert got == want
