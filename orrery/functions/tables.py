"""Tables of an application in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a counted table up to which it is broadcast.
SMALL = 32 << 20
#: Whether a query's shuffle files go when it ends (a setting of Spark's).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session on one machine that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table and read it back: a short lineage of files that outlive executors.

    Nothing comes back to the plan's shuffles, so Spark is told to delete them
    once the table is there.
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


def small(df: DataFrame, row_bytes: int, most: int = SMALL) -> DataFrame:
    """``df``, a stored table, to be broadcast if its rows, counted, take ``most`` bytes at the most."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
