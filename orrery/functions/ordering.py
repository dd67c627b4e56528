"""Numbers of rows in an order, and joins with reduced sides, without one task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import store


def numbered(df: DataFrame, by: str, out: str, parts: int | None = None) -> DataFrame:
    """Add ``out``: the row's number from 1 in the order of ``by``, a column of any type that has an order.

    Rows are dealt over ranges and stored with the number of theirs, since
    ranges are drawn anew whenever a plan runs; ranges are counted, and a
    window runs in each. Nulls come first.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = store(df.repartitionByRange(parts, by).withColumn("__range", F.spark_partition_id()), "ranges")
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    before = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(every), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(by)
    return rows.join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.row_number().over(inside)).drop("__range", "__before")


def join_reduced(rows: DataFrame, reduced: DataFrame, key: str, by: str, parts: int = 16) -> DataFrame:
    """``rows`` inner-joined on ``key`` with a table that has one row for each key, such as a grouped aggregate.

    Were the aggregate joined as it is, all rows of a key would meet in the
    task that made its aggregate. Here each row meets one of ``parts`` copies
    of it, by the hash of column ``by``, and copies are shuffled like rows, so
    that Spark may split them further.
    """
    copies = reduced.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("__part", F.pmod(F.hash(by), F.lit(parts)))
    return dealt.join(copies, [key, "__part"]).drop("__part")
