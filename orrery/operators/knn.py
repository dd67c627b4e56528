"""Nearest neighbours of every vector, and a map that keeps neighbours together.

Neighbours are looked for in several orders of the vectors. An order goes by
the sides of random planes, first plane first, then along a line: rows that
stand together in it lie in one part of the space. Each order is dealt over
ranges and cut into blocks of at most BLOCK rows, and distances are taken
within blocks only, so work and memory are bounded whatever the vectors are.
What several orders find for a row is put together, and then the neighbours of
its neighbours are tried as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import store

#: Rows of a block, orders, and planes of an order.
BLOCK, ORDERS, PLANES = 1024, 8, 16
SEED = 7
FOUND = "a long, b long, d double"


def _ordered(batches: Iterator[pa.RecordBatch], orders: int) -> Iterator[pa.RecordBatch]:
    """(order, side, along, id, v): each vector's place in each order."""
    for b in batches:
        v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
        for t in range(orders if b.num_rows else 0):
            g = np.random.default_rng((SEED, t, v.shape[1]))
            sides = (v @ g.standard_normal((v.shape[1], PLANES)) > 0) @ (1 << np.arange(PLANES)[::-1])
            along = v @ g.standard_normal(v.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(sides.astype(np.int32)), pa.array(along), b.column(0), b.column(1)], ["t", "side", "along", "id", "v"])


def _nearest(ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of each row of a block within it, ties to the smaller id."""
    square = (v * v).sum(axis=1)
    apart = np.maximum(square[:, None] + square - 2 * v @ v.T, 0)
    np.fill_diagonal(apart, np.inf)
    take = min(k, len(ids) - 1)
    near = np.lexsort((np.broadcast_to(ids, apart.shape), apart), axis=1)[:, :take] if take else np.empty((len(ids), 0), int)
    a, b = np.repeat(ids, take), ids[near].ravel()
    d = np.sqrt(np.take_along_axis(apart, near, axis=1)).ravel() if take else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d)], ["a", "b", "d"])


def _within_blocks(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from sorted rows (t, id, v), block by block of one order."""
    now, ids, vectors = None, [], []
    for b in batches:
        for t, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if ids and (t != now or len(ids) == block):
                yield _nearest(np.array(ids), np.array(vectors), k)
                ids, vectors = [], []
            now = t
            ids.append(i)
            vectors.append(v)
    if ids:
        yield _nearest(np.array(ids), np.array(vectors), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy("d", "b")
    each = found.groupBy("a", "b").agg(F.min("d").alias("d"))
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(df: DataFrame, key: str, vector: str, k: int = 10, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(a, b, d, rank): up to ``k`` nearest found of every row by Euclidean distance, rows named by a numeric, unique key.

    Rows without a key or a vector, or with a null or non-finite component,
    take no part. All vectors have one length.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & whole)
    rows = store(rows, "vectors")
    places = rows.mapInArrow(lambda it: _ordered(it, orders), "t int, side int, along double, id long, v array<double>")
    # Stored, because ranges are drawn from a reading of their own.
    dealt = store(places, "orders").repartitionByRange("t", "side", "along", "id").sortWithinPartitions("t", "side", "along", "id")
    found = store(_best(dealt.select("t", "id", "v").mapInArrow(lambda it: _within_blocks(it, k, block), FOUND), k), "found")
    # A neighbour's neighbours: k times k for each row.
    step = found.select("a", F.col("b").alias("m")).join(found.select(F.col("a").alias("m"), "b"), "m").where("a <> b").select("a", "b").distinct().join(found.select("a", "b"), ["a", "b"], "left_anti")
    v = lambda x: rows.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    apart = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    more = step.join(v("a"), "a").join(v("b"), "b").select("a", "b", apart.alias("d"))
    return _best(found.select("a", "b", "d").union(more), k)


def layout(start: DataFrame, found: DataFrame, rounds: int = 24) -> DataFrame:
    """(id, x, y): a map by the main slow directions of a walk over the graph of neighbours.

    ``start`` (id, x, y) is any first map, such as the main axes. In each round
    a row goes half-way to the mean of those it is a neighbour of either way,
    and the map is centred, its axes parted and brought back to size: power
    iteration for the graph's second and third eigenvectors. Rounds are joins
    and sums; the driver sees six numbers a round.
    """
    ties = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ties = store(ties, "ties")
    degree = store(ties.groupBy(F.col("a").alias("id")).agg(F.count("*").cast("double").alias("k")), "degree")
    at = store(start.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(degree, "id"), "map")
    for r in range(rounds):
        mean = ties.join(at.select(F.col("id").alias("b"), "x", "y"), "b").groupBy(F.col("a").alias("id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        at = store(at.join(mean, "id").select("id", "k", ((F.col("x") + F.col("mx")) / 2).alias("x"), ((F.col("y") + F.col("my")) / 2).alias("y")), "map")
        k, x, y = F.col("k"), F.col("x"), F.col("y")
        s = at.agg(F.sum(k).alias("k"), F.sum(k * x).alias("x"), F.sum(k * y).alias("y"), F.sum(k * x * x).alias("xx"), F.sum(k * x * y).alias("xy"), F.sum(k * y * y).alias("yy")).first()
        if not s["k"]:
            break
        cx, cy = s["x"] / s["k"], s["y"] / s["k"]
        xx, xy, yy = s["xx"] / s["k"] - cx * cx, s["xy"] / s["k"] - cx * cy, s["yy"] / s["k"] - cy * cy
        lean = xy / xx if xx > 0 else 0.0
        wide, high = max(xx, 0.0) ** 0.5 or 1.0, max(yy - lean * xy, 0.0) ** 0.5 or 1.0
        u = x - cx
        at = at.select("id", "k", (u / wide).alias("x"), ((y - cy - lean * u) / high).alias("y"))
    return at.select("id", "x", "y")
