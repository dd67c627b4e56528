"""Centroids, similarities and nearest rows of vectors kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import join_reduced


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v.cast("array<double>"))


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid): means by position, summed where the rows are."""
    cells = df.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(df: DataFrame, by: str, key: str, vector: str, top: int = 5) -> DataFrame:
    """(by, key, rank, score): the rows of each group nearest to its centroid by dot product."""
    scored = join_reduced(df, centroids(df, by, vector), by, key).select(by, key, F.round(dot(F.col(vector), F.col("centroid")), 6).alias("score"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def nearest_in_plane(df: DataFrame, by: str, key: str, x: str, y: str, top: int = 5) -> DataFrame:
    """(by, key, rank, distance): the rows nearest to their group's centre in the plane."""
    mid = df.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    d = join_reduced(df, mid, by, key).select(by, key, F.round(F.sqrt(F.pow(F.col(x) - F.col("cx"), F.lit(2)) + F.pow(F.col(y) - F.col("cy"), F.lit(2))), 6).alias("distance"))
    w = Window.partitionBy(by).orderBy("distance", key)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def drill_down(df: DataFrame, key: str, vector: str, clusters: int, seed: int = 7) -> DataFrame:
    """(key, drill_x, drill_y, drill_cluster): the rows projected anew on their two main axes and clustered again.

    For the rows of one cluster, of one player or of one field: what was
    alike in the whole map is told apart here.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    placed = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows)
    placed = KMeans(k=clusters, seed=seed, featuresCol="v", predictionCol="drill_cluster").fit(rows).transform(placed)
    p = vector_to_array("p")
    return placed.select(key, F.round(p[0], 6).alias("drill_x"), F.round(p[1], 6).alias("drill_y"), "drill_cluster")


#: Coordinate columns by priority.
COORDINATES = (("umap_x", "umap_y"), ("drill_x", "drill_y"), ("x", "y"))


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    for pair in COORDINATES:
        if set(pair) <= set(df.columns):
            return pair
    raise ValueError("no coordinate columns")


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """True where the point lies in the polygon: an odd number of its edges is to the right."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        if ay == by:
            continue
        meets = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        crossed = crossed + meets.cast("int")
    return crossed % 2 == 1
