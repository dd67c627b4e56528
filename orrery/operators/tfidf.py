"""TF-IDF as relations: (doc, term, weight) instead of a sparse matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import small, store

#: What a term of a vocabulary is held to take.
TERM_BYTES = 64
#: Terms of a corpus's own vocabulary that all tasks get: of a larger one the most frequent, which most rows have.
FREQUENT = 1 << 17


def term_counts(df: DataFrame, key: str, toks: Column) -> DataFrame:
    """(key, term, tf): occurrences. Texts are dealt by key, which takes less room than their terms do; what goes on by key stays where it is."""
    return df.repartition(key).select(key, F.explode(toks).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _document_terms(df: DataFrame, key: str, toks: Column) -> DataFrame:
    """(term): one row for each document and term. Only where a key has several rows these are dealt by key, to count its terms once."""
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return df.select(F.explode(F.array_distinct(toks)).alias("term"))
    return term_counts(df, key, toks).select("term")


def _scored(df: DataFrame, terms: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """(term, df, idf): the terms in min_df documents or more; idf is null for those in over max_df of all."""
    n = df.agg(F.count("*").alias("docs"))  # one row
    terms = terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(F.col("df") >= min_df)
    return terms.select("term", "df", F.when(F.col("df") <= max_df * F.col("docs"), F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def fit(df: DataFrame, key: str, toks: Column, min_df: int = 5, max_df: float = 0.80, tf: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): the vocabulary of a corpus, to be stored and applied to later texts.

    idf is ln((1 + n) / (1 + df)) + 1. Terms in fewer than min_df documents or
    over max_df of all are pruned. n counts all rows, those without terms
    included. ``tf`` are the corpus's term counts, where they are at hand.
    """
    return _scored(df, _document_terms(df, key, toks) if tf is None else tf, min_df, max_df).where("idf is not null")


def _by_frequency(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A stored vocabulary's FREQUENT most frequent terms or about as many, and the others, of which none is in over 1 / FREQUENT of all rows."""
    n = vocabulary.count()
    if n <= FREQUENT:
        return vocabulary, None
    least = vocabulary.agg(F.percentile_approx("df", 1 - FREQUENT / n, 10_000).alias("df")).first()["df"]
    return vocabulary.where(F.col("df") > least), vocabulary.where((F.col("df") <= least) & F.col("idf").isNotNull())


def _unit(raw: DataFrame, key: str) -> DataFrame:
    return raw.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


def transform(df: DataFrame, vocabulary: DataFrame, key: str, toks: Column) -> DataFrame:
    """(key, term, weight) of texts by a fitted, stored vocabulary: tf times idf, each document at unit length; other terms don't count.

    The vocabulary's rows are counted: a small one goes to all tasks, and then
    texts aren't shuffled by term.
    """
    tf = term_counts(df, key, toks)
    lookup = small(vocabulary.select("term", "idf"), TERM_BYTES)
    return _unit(tf.join(lookup, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")), key)


def tfidf(df: DataFrame, key: str, toks: Column, min_df: int = 5, max_df: float = 0.80) -> DataFrame:
    """(key, term, weight): tf times idf by the corpus's own vocabulary, each document at unit length; see ``fit``.

    The vocabulary is stored. Its frequent terms go to all tasks; only the
    other terms' rows are shuffled by term, and what is found for them meets
    the texts when these are dealt by key, the one time that they are.
    """
    vocabulary = store(_scored(df, _document_terms(df, key, toks), min_df, max_df), "vocabulary")
    frequent, others = _by_frequency(vocabulary)
    lookup = F.broadcast(frequent)
    rows = df.withColumns({"__term": F.lit(None).cast("string"), "__idf": F.lit(None).cast("double")})
    if others is not None:
        rare = df.select(key, F.explode(F.array_distinct(toks)).alias("term")).join(lookup, "term", "left").where("df is null").select(key, "term")
        found = rare.join(others.select("term", F.col("idf").alias("__idf")), "term").select(key, F.col("term").alias("__term"), "__idf")
        rows = rows.unionByName(found, allowMissingColumns=True)
    # A row is a text, or a term of one with its idf.
    text = F.col("__idf").isNull()
    terms = rows.repartition(key).select(key, "__idf", F.explode(F.when(text, toks).otherwise(F.array("__term"))).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count_if(text).alias("tf"), F.max("__idf").alias("__idf"))
    raw = tf.join(lookup, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", "__idf")).alias("w")).where("w is not null")
    return _unit(raw, key)


def cluster_terms(weights: DataFrame, clusters: DataFrame, key: str, cluster: str, top: int = 10) -> DataFrame:
    """(cluster, rank, term, weight): the terms of highest mean weight over all rows of a cluster.

    Rows without the term count as 0. Noise (-1) and null clusters are left out.
    """
    own = clusters.where(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-1"))
    sizes = own.groupBy(cluster).agg(F.count("*").alias("size"))
    mean = weights.join(own, key).groupBy(cluster, "term").agg(F.sum("weight").alias("s")).join(sizes, cluster)
    mean = mean.select(cluster, "term", F.round(F.col("s") / F.col("size"), 6).alias("weight")).where("weight > 0")
    w = Window.partitionBy(cluster).orderBy(F.desc("weight"), "term")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(cluster, "rank", "term", "weight")
