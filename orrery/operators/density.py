"""Clusters of dense regions, and noise between them, in a map of a few dimensions.

A row is a core if ``least`` rows, itself included, lie within ``eps`` of it.
Cores within ``eps`` of one another share a cluster; a row near a core is at
its border; all others are noise, -1.

The map is cut into cells in which any two rows are within ``eps``, so that a
cell of ``least`` rows needs no distances and a cell's cores are one cluster.
Rows of other cells meet those of the cells around them in an equi-join, few
rows of theirs at most for each row there. Whether the cores of two cells meet
is decided by the bounds of parts of the cells first, and row by row only where
these leave it open. Rows of equal coordinates are one place throughout.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.tables import small, store
from .network import communities

NOISE = -1
#: Parts of a cell along each dimension.
PARTS = 8


def _cell(coords: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side).cast("long") for c in coords])


def _square(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def _around(coords: list[str], eps: float, side: float) -> Column:
    """The cells that may hold something within ``eps`` of a row of column cell."""
    reach = range(-int(eps / side) - 1, int(eps / side) + 2)
    # Cells whose nearest corners are farther apart than eps are left out.
    far = lambda o: sum(max(abs(x) - 1, 0) ** 2 for x in o) * side * side > eps * eps * (1 + 1e-9)
    offsets = [o for o in itertools.product(reach, repeat=len(coords)) if not far(o)]
    return F.explode(F.array(*[F.array(*[F.get("cell", F.lit(k)) + x for k, x in enumerate(o)]) for o in offsets]))


def _touching(cores: DataFrame, coords: list[str], eps: float, side: float) -> DataFrame:
    """(a, b): the least places of pairs of cells of which two cores, rows (id, cell, coordinates), are within ``eps``."""
    part = F.array(*[F.least(F.floor((F.col(c) / side - F.floor(F.col(c) / side)) * PARTS), F.lit(PARTS - 1)).cast("int") for c in coords])
    bounds = [f(c).alias(f"{p}_{c}") for c in coords for p, f in (("lo", F.min), ("hi", F.max))]
    parts = store(cores.withColumn("part", part).groupBy("cell", "part").agg(*bounds), "parts")
    cells = store(cores.groupBy("cell").agg(F.min("id").alias("id")), "cells")
    pairs = cells.select("id", "cell", _around(coords, eps, side).alias("other")).join(cells.select(F.col("cell").alias("other"), F.col("id").alias("b")), "other").where("id < b")
    pairs = store(pairs.select(F.col("id").alias("a"), F.col("cell").alias("cell_a"), "b", F.col("other").alias("cell_b")), "pairs")
    left, right = (parts.select(*[F.col(c).alias(f"{c}_{s}") for c in parts.columns]) for s in "ab")
    met = pairs.join(left, "cell_a").join(right, "cell_b")
    gap = [F.greatest(F.col(f"lo_{c}_a") - F.col(f"hi_{c}_b"), F.col(f"lo_{c}_b") - F.col(f"hi_{c}_a"), F.lit(0.0)) for c in coords]
    span = [F.greatest(F.col(f"hi_{c}_b") - F.col(f"lo_{c}_a"), F.col(f"hi_{c}_a") - F.col(f"lo_{c}_b")) for c in coords]
    most = F.lit(eps * eps)
    near, sure = (sum((x * x for x in xs), F.lit(0.0)) <= most for xs in (gap, span))
    met = store(met.where(near).select("a", "b", "cell_a", "part_a", "cell_b", "part_b", sure.alias("sure")), "met")
    linked = store(met.where("sure").select("a", "b").distinct(), "linked")
    open_ = met.join(linked, ["a", "b"], "left_anti")
    mine, yours = (cores.withColumn("part", part).select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "part", *coords)]) for s in "ab")
    found = open_.join(mine, ["cell_a", "part_a"]).join(yours, ["cell_b", "part_b"]).where(_square([F.col(f"{c}_a") for c in coords], [F.col(f"{c}_b") for c in coords]) <= most)
    return linked.union(found.select("a", "b").distinct())


def density_clusters(df: DataFrame, key: str, coords: list[str], eps: float, least: int) -> DataFrame:
    """(key, cluster, core): cluster is -1 for noise, else a number from 0 in the order of the clusters' least core keys.

    A row at the border of several clusters goes to the one with the smallest
    number. Rows with a coordinate that is null or no finite number are noise.
    """
    side = eps / math.sqrt(len(coords)) * (1 - 1e-9)
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in coords])
    whole = F.lit(True)
    for c in coords:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    places = rows.where(whole).groupBy(*coords).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    places = store(places.withColumns({"cell": _cell(coords, side), "id": F.monotonically_increasing_id()}), "places")
    full = store(places.groupBy("cell").agg(F.sum("n").alias("total")).where(F.col("total") >= least).select("cell"), "full")
    thin = store(places.join(full, "cell", "left_anti"), "thin")
    asks = lambda rows: rows.select(F.col("id").alias("asks"), *[F.col(c).alias(f"{c}_") for c in coords], _around(coords, eps, side).alias("cell"))
    within = _square([F.col(c) for c in coords], [F.col(f"{c}_") for c in coords]) <= F.lit(eps * eps)
    crowd = asks(thin).join(places, "cell").where(within).groupBy("asks").agg(F.sum("n").alias("around")).where(F.col("around") >= least)
    crowd = store(crowd.select(F.col("asks").alias("id")), "crowd")
    cores = store(places.join(full, "cell", "left_semi").unionByName(thin.join(crowd, "id", "left_semi")), "cores")
    edges = _touching(cores, coords, eps, side).withColumn("n", F.lit(1))
    groups = communities(edges).select(F.col("node").alias("cell_id"), "component")
    cells = cores.groupBy("cell").agg(F.min("id").alias("cell_id"), F.min("first").alias("first"))
    cells = store(cells.join(groups, "cell_id", "left").withColumn("component", F.coalesce("component", "cell_id")), "cells")
    names = store(numbered(cells.groupBy("component").agg(F.min("first").alias("first")), "first", "number"), "names")
    cells = store(cells.join(names.select("component", (F.col("number") - 1).alias("cluster")), "component").select("cell", "cluster"), "clusters")
    inner = store(cores.join(cells, "cell").select("id", "cell", *coords, "cluster"), "inner")
    edge = asks(thin.join(crowd, "id", "left_anti")).join(inner.drop("id"), "cell").where(within).groupBy("asks").agg(F.min("cluster").alias("cluster"))
    found = inner.select("id", "cluster", F.lit(True).alias("core")).union(edge.select("asks", "cluster", F.lit(False)))
    found = store(places.join(found, "id").select(*[F.col(c).alias(f"{c}_") for c in coords], "cluster", "core"), "found")
    same = [F.col(c) == F.col(f"{c}_") for c in coords]
    out = rows.join(small(found, 64), same, "left")
    return out.select(key, F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
