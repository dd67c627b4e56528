"""Shared pieces: word splitting, scratch tables and ordered prefix sums."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, in Java's and in RE2's syntax.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Whether a query's shuffle files go when it ends (a setting of Spark's).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """Hash of ``text`` that tells rows which share an id, or have none, apart; null counts as an empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as an empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_slices(texts: pa.Array, most: int = 8 << 20):
    """Consecutive (start, stop) of rows of at most ``most`` bytes of text together, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, end
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, counts): the distinct words of whole texts, every word in turn as its place among them, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    shown = np.append(pc.not_equal(words, "").to_numpy(zero_copy_only=False), False)[codes]
    ends = np.concatenate(([0], np.cumsum(shown)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return words, codes[shown], np.diff(ends)


def worker_state(owner: str) -> dict:
    """A dict that lives as long as the Python process: an operator's caches that outlast a task.

    Only the operator that ran last has one; a worker that goes on to another
    gives the memory back.
    """
    kept = sys.modules.setdefault("_orrery_worker_state", types.ModuleType("_orrery_worker_state")).__dict__
    if kept.get("owner") != owner:
        kept.clear()
        kept |= {"owner": owner, "state": {}}
        gc.collect()
    return kept["state"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session without that setting (tests on one machine) gets a folder
    of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage: what follows re-reads files that survive the loss
    of executors. Column types and names stay. Nothing comes back to the
    plan's shuffles, so Spark is told to delete them once the table is there.
    All tables of an application are in one folder of its own, which can go
    when its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``df``, a stored table, to be broadcast if its rows of ``row_bytes`` bytes, counted, take ``most`` at the most."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_points(df: DataFrame, col: str, parts: int) -> list:
    """At most ``parts`` - 1 ascending values that cut ``col`` into even ranges.

    One aggregate; the driver gets ``parts`` - 1 numbers whatever the input.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(col, at, 20 * parts).alias("p")).first()["p"]
    return sorted(set(got or []))


def range_bucket(col: Column, points: list) -> Column:
    """Number of split points below or at ``col``: a monotone bucket number."""
    if not points:
        return F.lit(0)
    arr = F.array(*[F.lit(p) for p in points])
    return F.size(F.filter(arr, lambda p: p <= col))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group.

    Rows are ordered by (bucket, order). Only one bucket of a group meets in
    a task: bucket totals are summed first, their running totals are joined
    back, and a window runs inside each bucket.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # Stored, so that Spark can split a bucket of very many rows when it meets its total.
    totals = store(totals.select(*group, bucket, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base")), "totals")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, [*group, bucket])
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__base")
    )


def last_before(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the last value that isn't null in earlier rows of the group, in the order (bucket, order); buckets as in running_total."""
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.where(F.col(value).isNotNull()).groupBy(*group, bucket).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    every = df.select(*group, bucket).distinct().join(ends, [*group, bucket], "left")
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = store(every.select(*group, bucket, F.last("__last", ignorenulls=True).over(before).alias("__carried")), "carried")
    return df.join(carried, [*group, bucket]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__carried")).drop("__carried")
