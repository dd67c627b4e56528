"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws a uniform number u from a hash of its id and a seed; its
key is -ln(u) / quality weight, so taking a source's documents by ascending
key is a weighted sample without replacement. A source whose target reaches
its size gives whole epochs first; the rest of the target is filled in key
order as far as prefix sums allow, then again from the documents left over
that still fit, a fixed number of times, and with one more document where that
brings the total nearer. Documents whose weight is 0, negative or NaN come after
all others of their source, in random order among themselves; a document
without a weight has 1.

Edge cases: a null text has size 0 and is never taken; a null source is a
source of its own, after all others; rows that share an id share their key
and are taken one by one; equal keys fall back to the id and the size; a
corpus without words, or an empty table, gets targets of 0. Only the named
columns are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_small, running_total, store, table, word_count

WEIGHTS = (5, 2, 1)
#: Weight of documents by labels.quality; documents without a label get 1.
QUALITY = {1: 2.0, 0: 0.5}
PASSES = 4
#: Factor of the keys of documents without weight: after all others.
LATE = 1e300
#: Bytes that a source's row is held to take at the most.
SOURCE_BYTES = 256


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size), one row per source.

    Sharing by weight with the excess over ``cap`` times a source's size
    reshared is a common level per weight: sources fill up in ascending order
    of cap / weight, until the level that the rest can have is below their
    caps. The window holds one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Strings compare by UTF-8 bytes, which is the order of code points.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("goal", F.sum("source_size").over(every) * share)
    s = s.withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The level rises as long as sources fill up, then falls.
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", "n_docs", F.least("most", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per row of ``docs``.

    ``quality`` is (id, weight); the mean counts where an id repeats.
    ``row_col`` names a long that is unique among the rows; the result then
    has it too, as row, and how often the row is taken, as times.
    """
    own = [F.col(row_col).alias("row")] if row_col else []
    rows = store(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *own), "sizes")
    goal = store(targets(rows, weights, share, cap), "targets").withColumnRenamed("source", "s")
    rows = rows.join(broadcast_small(goal, SOURCE_BYTES), F.expr("source <=> s")).drop("s")
    if quality is not None:
        rows = rows.join(quality.groupBy("id").agg(F.avg("weight").alias("weight")), "id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    # 48 bits of MD5, so that any engine can draw the same numbers.
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    base, weight = -F.log((draw + 0.5) / float(1 << 48)), F.coalesce("weight", F.lit(1.0))
    some = (weight > 0) & ~F.isnan(weight)
    key = F.when(some, base / weight).otherwise(LATE * (1 + base))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    buckets = F.ceil(F.sqrt("n_docs"))
    rows = rows.select("id", "source", "size", "source_size", "target", key.alias("key"), epochs.alias("epochs"), F.when(some, F.floor((1 - F.exp(-key)) * buckets)).otherwise(buckets + F.floor((1 - F.exp(-base)) * buckets)).alias("bucket"), F.col("row") if row_col else F.monotonically_increasing_id().alias("row"))
    rows = store(rows, "drawn")
    whole = goal.select("s", (F.col("target") - F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0) * F.col("source_size")).alias("rest"))
    candidates = rows.where("size > 0").select("row", "id", "source", "size", "key", "bucket")
    picked = store(candidates.limit(0).select("row", "source", "size"), "picked")
    for turn in range(PASSES + 1):
        used = picked.groupBy(F.col("source").alias("u")).agg(F.sum("size").alias("used"))
        left = store(whole.join(used, F.expr("s <=> u"), "left").select("s", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("room")), "room")
        # One row a source: a source's documents stay where they are.
        open_ = candidates.join(picked.select("row"), "row", "left_anti").join(broadcast_small(left, SOURCE_BYTES), F.expr("source <=> s")).drop("s")
        if turn == PASSES:
            # What is left is less than most documents: one more if that comes nearer.
            least = F.min(F.struct(F.abs(F.col("size") - F.col("room")).alias("off"), "key", "row", "size")).alias("m")
            picks = open_.where("size < 2 * room").groupBy("source").agg(least).select("m.row", "source", "m.size")
        else:
            open_ = running_total(open_.where("size <= room").withColumn("g", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), ["g"], "bucket", ["key", "id", "size", "row"], "size", "before")
            picks = open_.where("before + size <= room").select("row", "source", "size")
        picked = picked.union(store(picks, "picks"))
    times = F.col("epochs") + F.coalesce("now", F.lit(0))
    rows = rows.join(picked.select("row", F.lit(1).alias("now")), "row", "left")
    return rows.select("id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), *(["row", times.alias("times")] if row_col else []))


def quality_weights(labels: DataFrame) -> DataFrame:
    w = F.lit(1.0)
    for k, v in QUALITY.items():
        w = F.when(F.col("quality") == k, F.lit(v)).otherwise(w)
    return labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), w.alias("weight"))


def op4(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
