"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before it kept, and its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import lines, mixing, packing, simhash, toxicity
from orrery.llm.common import store, table, text_key, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; rows with a null id stay or go by their own score."""
    model, rate = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, base_rate=rate)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later copies of a three-line window cover; n_chars follows the text."""
    return lines.deduplicate_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay.

    Near copies have a Jaccard similarity of their five-word shingles of 0.8
    or more; groups are what such pairs connect.
    """
    found = simhash.near_copies(docs, size=5, bound=0.8)
    gone, key = unused(docs, "gone", "gone_key")
    found = found.where("id <> component_id").select(F.col("id").alias(gone), F.col("text_key").alias(key)).distinct()
    return docs.join(found, (docs["doc_id"].cast("long") == found[gone]) & (text_key(docs["text"].cast("string")) == found[key]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    row, key, n, turn = unused(docs, "mix_row", "mix_key", "mix_times", "mix_turn")
    # Written once, so that a row's number stays the same in both readings.
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    mixed = mixing.mix(rows, mixing.quality_weights(table(spark, sf_dir, "labels")), row_col=row)
    times = mixed.where("taken > 0").select(F.col("row").alias(key), F.col("times").cast("int").alias(n))
    taken = rows.join(times, rows[row] == times[key])
    # A row for each time that the mix takes the document.
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(turn)).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, mixed in every window as the sources are in all."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The classifier, the fingerprints' hash and the tokenizer have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(out, f"stage-{k}")
    return out
