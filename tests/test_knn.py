"""Neighbours and maps against brute force."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from orrery.operators import knn



def plain(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall(spark, kind):
    """At least 0.9 of the ten nearest, with blocks of a tenth of the rows; distances are exact."""
    g = np.random.default_rng(2)
    x = g.standard_normal((1500, 12))
    if kind == "clusters":
        x = g.standard_normal((15, 12))[g.integers(0, 15, 1500)] * 4 + x * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    near, d = plain(x, 10)
    got = knn.neighbours(df, "k", "v", 10, block=150).collect()
    assert len(got) == 15000 and all(abs(r["d"] - d[r["a"], r["b"]]) < 1e-6 for r in got)
    assert sum(r["b"] in near[r["a"]] for r in got) >= 0.9 * len(got)


def test_equal_and_missing_vectors(spark):
    """A third of the rows hold one vector; rows without one take no part; few rows have few neighbours."""
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), -float(i)]) for i in range(300)] + [(900, None), (901, [math.nan, 0.0]), (902, [None, 1.0]), (None, [1.0, 2.0])]
    got = knn.neighbours(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3, block=40).collect()
    assert {r["a"] for r in got} == set(range(300)) and all(r["d"] == 0 for r in got if r["a"] % 3 == 0)
    two = knn.neighbours(spark.createDataFrame(rows[:2], "k long, v array<double>"), "k", "v", 3).collect()
    assert sorted((r["a"], r["b"], r["rank"]) for r in two) == [(0, 1, 1), (1, 0, 1)]
    assert knn.neighbours(spark.createDataFrame([], "k long, v array<double>"), "k", "v").count() == 0


def kept(x, xy, k=10):
    """The share of rows' nearest in the space that are among their nearest in the map."""
    a, b = plain(x, k)[0], plain(xy, k)[0]
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(a, b)])


def test_map_keeps_neighbours_better_than_the_main_axes(spark, sf_dir):
    """Over all embeddings of the given table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"]).astype(float)
    at = lambda name: entry.queries()[name](spark, sf_dir).toPandas().sort_values("vec_id")[["umap_x", "umap_y"]].to_numpy()
    assert kept(x, at("landscape_neighbours")) > kept(x, at("landscape_pca")) + 0.02
