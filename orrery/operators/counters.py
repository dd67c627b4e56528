"""Counts of what a job did, taken while it does it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Named counts of rows that flow through one place of a plan, ready once the plan has been written.

    They come with the job that writes the rows; there is no second pass.
    """

    def __init__(self, df: DataFrame, **conditions: Column):
        """``conditions`` name rows to count besides all (rows): those for which a condition holds."""
        self._seen, self._names = Observation(), ["rows", *conditions]
        counts = [F.count(F.when(c, F.lit(1))).alias(n) for n, c in conditions.items()]
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *counts)

    def get(self) -> dict[str, int]:
        """The counts of the first job that ran over ``df``."""
        found = self._seen.get
        return {n: found.get(n, 0) for n in self._names}


def written(spark: SparkSession, counters: Counters, write: Callable[[DataFrame], None]) -> DataFrame:
    """(counter, n), one row each, after ``write`` has been given the counted rows; elapsed_ms is among them."""
    began = time.monotonic()
    write(counters.df)
    found = counters.get() | {"elapsed_ms": int(1000 * (time.monotonic() - began))}
    return spark.createDataFrame(list(found.items()), "counter string, n long")
