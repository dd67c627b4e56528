"""Cluster labels: read from pasted JSON, applied, edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code fence around pasted JSON, and the placeholder label.
FENCE = "(?m)^```json\\s*|^```\\s*|```$"
PLACEHOLDER = "(該当なし)"
NOISE = -1


def parse(c: Column) -> Column:
    """A JSON object of labels as a map, null if malformed."""
    return F.from_json(F.regexp_replace(c, FENCE, ""), "map<string,string>")


def entries(df: DataFrame, col: str) -> DataFrame:
    """(cluster_id, label): the entries whose keys are whole numbers."""
    e = df.select(F.explode(parse(F.col(col))).alias("k", "label"))
    return e.select(F.expr("try_cast(k as int)").alias("cluster_id"), "label").where("cluster_id is not null")


def apply(df: DataFrame, cluster: str, labels: DataFrame) -> DataFrame:
    """df with the label "[id] text" of each row's cluster; null where there is none.

    Labels of clusters that df doesn't have are ignored.
    """
    known = labels.join(df.select(F.col(cluster).alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    text = known.groupBy("cluster_id").agg(F.max("label").alias("label"))
    text = text.select(F.col("cluster_id").alias(cluster), F.concat(F.lit("["), F.col("cluster_id").cast("string"), F.lit("] "), "label").alias("label_text"))
    return df.join(text, cluster, "left")


def merged(current: DataFrame, pasted: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, label, change): the current labels with the pasted ones put in as "[id] text".

    A pasted label counts if its cluster is among the current labels or the
    clusters (cluster_id); of several for one cluster the greatest does.
    Change is "kept", "updated" or "added"; the last two are the count of
    labels set.
    """
    known = current.select("cluster_id").union(clusters.select("cluster_id")).distinct()
    new = pasted.join(known, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.max("label").alias("new"))
    text = F.concat(F.lit("["), F.col("cluster_id").cast("string"), F.lit("] "), "new")
    both = current.groupBy("cluster_id").agg(F.max("label").alias("old"), F.lit(True).alias("had")).join(new, "cluster_id", "full")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("had"), "updated").otherwise("added")
    return both.select("cluster_id", F.coalesce(text, "old").alias("label"), change.alias("change"))


def editable(labels: DataFrame) -> DataFrame:
    """Labels for an editor: ids ascending with noise last; placeholders are left out."""
    return labels.where(F.col("label") != PLACEHOLDER).orderBy(F.col("cluster_id") == NOISE, "cluster_id")


def merge(df: DataFrame, cluster: str, mapping: DataFrame) -> DataFrame:
    """df with clusters renamed by (old, new); others keep their id."""
    m = mapping.groupBy("old").agg(F.min("new").alias("new"))
    return df.join(m, df[cluster] == m["old"], "left").withColumn(cluster, F.coalesce("new", cluster)).drop("old", "new")
