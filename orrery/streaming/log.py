"""A numbered log of snapshots that batches of a stream append to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.reports import append_new


def log_schema(schema: StructType) -> StructType:
    return StructType([StructField("ordinal", LongType()), *schema.fields])


def create_log(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty log of snapshots with the fields of ``schema``, id among them; one that is there stays."""
    spark.createDataFrame([], log_schema(schema)).write.mode("ignore").parquet(f"{path}/batch=-1")


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log's rows (ordinal, fields of ``schema``)."""
    return spark.read.schema(StructType([*log_schema(schema).fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)


def appender(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends a batch's new snapshots to the log in ``path``.

    Every batch has a folder of its own and is numbered on from those before
    it. A batch that is offered again, after a failure, sees the same log as
    the first time and replaces what it wrote: nothing is lost, doubled or
    numbered anew. Snapshots without an id are left out.
    """

    def append(batch: DataFrame, number: int) -> None:
        log = read_log(batch.sparkSession, path, schema).where(F.col("batch") < number).drop("batch")
        fresh = append_new(log, batch.select(*schema.fieldNames()).where("id is not null"), only_new=True)
        fresh.select(*log.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return append
