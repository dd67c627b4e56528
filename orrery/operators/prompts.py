"""Texts that ask a language model for the names of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import small, store
from . import labels, vectors

#: What a key and its cluster are held to take.
ROW_BYTES = 64


def _joined(order: str, c: str, sep: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]), sep)


def cluster_prompts(df: DataFrame, cluster: str, key: str, texts: list[str], terms: DataFrame, top: int = 5, source: DataFrame | None = None) -> DataFrame:
    """(cluster, prompt): for each cluster its terms and the rows nearest to its centre in the plane.

    ``df`` has one of the known pairs of coordinates; ``terms`` is (cluster,
    rank, term). Noise and null clusters are left out; a cluster without terms
    stays, with none. A row shows its ``texts`` that aren't null, on one line.
    They are columns of ``df``, or of ``source``, which has ``key`` too: then
    the nearest rows are stored, and only their texts are shuffled.
    """
    own = df.where(F.col(cluster).isNotNull() & (F.col(cluster) != labels.NOISE))
    near = vectors.nearest_in_plane(own, cluster, key, *vectors.coordinate_columns(df), top).select(cluster, key, "rank")
    shown = F.concat(F.lit("  - "), F.concat_ws(" ", *[F.translate(F.col(c).cast("string"), "\n", " ") for c in texts]))
    if source is None:
        rows = near.join(own, [cluster, key])
    else:
        near = store(near, "nearest")
        rows = near.join(source.join(small(near.select(key), ROW_BYTES), key, "left_semi"), key, "left")
    rows = rows.select(cluster, "rank", shown.alias("line"))
    rows = rows.groupBy(cluster).agg(_joined("rank", "line", "\n").alias("lines"))
    words = terms.groupBy(cluster).agg(_joined("rank", "term", ", ").alias("terms"))
    parts = [F.lit("Cluster "), F.col(cluster).cast("string"), F.lit(":\nTerms: "), F.coalesce("terms", F.lit("")), F.lit("\nDocuments:\n"), F.col("lines")]
    return rows.join(words, cluster, "left").select(cluster, F.concat(*parts).alias("prompt"))
