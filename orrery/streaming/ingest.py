"""The stateless part of ingestion as a stream.

The date format and term statistics depend on a whole corpus; a stream takes
them from a batch: pass the fitted parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import DateParser
from ..operators import tfidf
from ..operators.enrich import enrich
from ..operators.schema import ColumnMap


def enriched_stream(spark: SparkSession, path: str, schema: StructType, roles: ColumnMap, dates: DateParser) -> DataFrame:
    """Files of Parquet that arrive in a folder, enriched row by row."""
    return enrich(spark.readStream.schema(schema).parquet(path), roles, dates)


def counts_by_window(events: DataFrame, when: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows in each window of event time, rows later than ``late`` left out once their window is closed."""
    return events.withWatermark(when, late).groupBy(F.window(when, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def weight_writer(path: str, vocabulary: DataFrame, key: str, toks: Column) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes the weights of a batch's texts by a fitted vocabulary, a folder for each batch.

    A batch that is offered again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        tfidf.transform(batch, vocabulary, key, toks).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
