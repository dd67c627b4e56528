"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import neighbours

TYPES = "vec_id long, embedding array<double>"


def plain(rows, k=10, step=100):
    """(query's place, [(score, id)]) of each query, from (id, vector) pairs; a null id comes last among equals."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (qid, q) in enumerate(good):
        if qid is not None and qid % step == 0:
            near = [(float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), math.inf if i is None else i) for b, (i, v) in enumerate(good) if b != at and len(v) == len(q)]
            out.append((qid, sorted(near)[:k]))
    return sorted(out)


def answers(df, k=10):
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 100 == 0, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], math.inf if r["vec_id"] is None else r["vec_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def recall(got, want):
    """Over scores, so that equal distances may stand for each other."""
    hits = sum(len({x for x, _ in near} & {x for x, _ in got.get(q, [])}) for q, near in want)
    return hits / sum(len({x for x, _ in near}) for _, near in want)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "line", "one length"])
def test_recall(spark, kind):
    """Measured against all distances, for vectors of several shapes."""
    g = np.random.default_rng(3)
    x = g.standard_normal((3000, 24))
    if kind == "clusters":
        x = g.standard_normal((30, 24))[g.integers(0, 30, 3000)] * 5 + x * 0.05
    if kind == "line":
        x = np.outer(g.exponential(size=3000) ** 3, np.ones(24)) + x * 1e-6
    if kind == "one length":
        x = x[:, :1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(spark.createDataFrame(rows, TYPES)), plain(rows)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q, _ in want}
    assert recall(got, want) >= 0.95


def test_edge_cases(spark):
    """Vectors that take no part, equal vectors and ids, null ids, other lengths, too few candidates."""
    rows = [
        (0, [1.0, 0.0]), (1, [0.9, 0.1]), (None, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [None, 1.0]),
        (8, [math.inf, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [1.0, 2.0, 3.0]), (300, [0.0, 0.0]), (400, [1.0, 2.0, 3.0, 4.0]), (9, [1.0, 2.0, 3.5]), (None, [5.0, 5.0]),
    ]
    got = {}
    df = spark.createDataFrame(rows, TYPES).withColumns({c: F.lit("clash") for c in ("id", "row", "vector", "bound", "query", "cell", "dim", "rank", "score")})
    for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))
    near, far = round(math.hypot(0.1, 0.1), 9), round(math.hypot(4, 5), 9)
    assert sorted(got) == [0, 100, 200]
    assert sorted(got[0]) == [(1, 0.0, 100), (2, 0.0, 100), (3, near, 1), (4, near, 2), (5, near, None), (6, far, None)]
    # Two rows of one id are two queries; each is the other's neighbour.
    assert sorted(got[100], key=str) == sorted(2 * [(1, 0.0, 0), (2, 0.0, 100), (3, near, 1), (4, near, 2), (5, near, None), (6, far, None)], key=str)
    assert got[200] == [(1, 0.5, 9)]


def test_one_vector_very_often(spark):
    """A third of all rows hold one vector: ties go to the smaller id, and nothing is left out."""
    g = np.random.default_rng(4)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else g.standard_normal(8).tolist()) for i in range(1500)]
    got = answers(spark.createDataFrame(rows, TYPES))
    for q, near in plain(rows):
        assert q % 3 or got[q] == near


def test_single_precision_and_empty(spark):
    rows = [(i, [float(np.float32(i) / 7), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(df)
    want = plain([(r["vec_id"], list(r["embedding"])) for r in df.collect()])
    assert recall(got, want) >= 0.95 and all(set(got[q]) <= {(s, i) for s, i in dict(plain([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 1000))[q]} for q in got)
    assert neighbours.nearest(spark.createDataFrame([], TYPES), F.col("id") % 100 == 0).collect() == []


def test_shards_agree(spark):
    """Another number of shards gives the nearest as well."""
    g = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(g.standard_normal((800, 16)))]
    want = plain(rows)
    kept, neighbours.SHARD = neighbours.SHARD, 50
    try:
        assert recall(answers(spark.createDataFrame(rows, TYPES)), want) >= 0.95
    finally:
        neighbours.SHARD = kept
