"""Document fingerprints: one-permutation MinHash of word shingles.

Each shingle of five words is hashed once. The hash's top bits choose one of
256 bins, and a bin keeps the least hash that falls into it. An empty bin
takes the value of another by optimal densification: a fixed random probe
sequence of its own, the same for every document, until a bin is filled. Of
each bin the low four bits are stored, sixteen bins to a long. Unequal bins
agree by chance in one of 2^4 cases; the likeness is corrected for that.

Edge cases: a null text is an empty one and has the all-zero fingerprint,
which is alike (1) to itself and unlike (0) any other; a text of fewer than
five words is one shingle; rows that share an id are fingerprinted one by
one; an empty table gives an empty table. Only the named columns are read, so
further columns can't clash.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bucket, shuffle_partitions, split_points, store, table, words

BINS = 256
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
PROBES = 8
SHINGLE = 5


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each shingle, made from its words' hashes."""
    h = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        # Fewer words than a shingle: fold all of them.
        short = F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= size, whole).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return bound(h, of)


def bound(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56).cast("int")


def bins(hashes: Column) -> Column:
    """Array of BINS longs: the least hash of each bin, null where it is empty."""

    def least(s: Column) -> Column:
        # Sorted as signed longs, a bin's hashes lie together: keep the first of each.
        firsts = F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))
        m = F.map_from_arrays(F.transform(firsts, _bin), firsts)
        return bound(m, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.try_element_at(m, i)))

    return bound(F.sort_array(hashes), least)


def probe_tables() -> list[Column]:
    """For each turn the bin that every bin asks: random, and the same for every document."""
    g = random.Random(BINS)
    return [F.array(*[F.lit(g.randrange(BINS)) for _ in range(BINS)]) for _ in range(PROBES)]


def densify(v: Column) -> Column:
    """Fill the empty bins of an array that has at least one filled."""

    def probe(filled: Column) -> Column:
        def rest(i: Column) -> Column:
            # What is still empty after the first probes takes the filled bin that comes first in the bin's own random order of all bins.
            places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(filled, j).isNotNull())
            order = F.transform(places, lambda j: F.xxhash64(i, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("long")))
            return F.get(filled, F.array_min(order).bitwiseAND(F.lit(BINS - 1)).cast("int"))

        return F.transform(filled, lambda x, i: F.coalesce(x, *[F.get(filled, F.get(t, i)) for t in probe_tables()], rest(i)))

    return F.when(F.exists(v, lambda x: x.isNull()), bound(v, probe)).otherwise(v)


def packed(v: Column) -> Column:
    """Low bits of the bins as an array of longs.

    A value is hashed with its bin first, so that the copies of one value in
    many bins don't agree by chance all at once.
    """

    def pack(v: Column) -> Column:
        def one(k: Column) -> Column:
            return F.aggregate(F.slice(v, k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    return bound(F.transform(v, lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit((1 << LOW_BITS) - 1))), pack)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text as array<bigint>."""
    zero = F.array_repeat(F.lit(0).cast("long"), BINS // PER_LONG)
    return bound(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, packed(densify(bins(h)))).otherwise(zero))


def as_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, corrected for chance agreement."""
    ones = int("1" * PER_LONG, 16)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(ones)))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW_BITS)
    agree = 1.0 - unlike / F.lit(float(BINS))
    empty = lambda fp: F.forall(fp, lambda x: x == 0)
    near = F.when(empty(a) | empty(b), (empty(a) & empty(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1.0 - chance)))
    return F.when(a.isNotNull() & b.isNotNull(), near)


def neighbours(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id) of the distinct ids in ascending order; the first follows the last.

    Ids are dealt over ranges; a window runs in each range, and the ranges'
    ends, one row a range, are linked by a window of their own.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    points = split_points(ids, "id", shuffle_partitions(docs.sparkSession))
    ids = ids.withColumn("range", range_bucket(F.col("id"), points))
    ends = ids.groupBy("range").agg(F.min("id").alias("least"))
    every = Window.orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("least").over(every), F.first("least").over(whole)).alias("after"))
    # At most one row for each split point.
    return ids.join(F.broadcast(ends), "range").select("id", F.coalesce(F.lead("id").over(Window.partitionBy("range").orderBy("id")), F.col("after")).alias("next_id"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document.

    The edit replaces the last floor(n / part) code points by the first as
    many of the next document's text (of its smallest text, should its id
    repeat). Rows with a null id have no next document: their edit only loses
    those code points, and near_next is null.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    # Used twice below with the same columns and filter, so that one shuffle of it serves both.
    texts = whole.where("id is not null")
    links = store(neighbours(docs, id_col), "links")
    # How many code points a document's predecessor asks of it.
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.floor(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) / part).alias("k")).groupBy("id").agg(F.max("k").alias("most"))
    asked = store(links.join(wanted, "id").select(F.col("next_id").alias("id"), F.col("id").alias("before"), "most"), "asked")
    heads = texts.join(asked, "id").select(F.col("before").alias("id"), F.struct(F.substring("text", F.lit(1), F.col("most").cast("int")).alias("head"), F.col("fp").alias("next_fp")).alias("h"))
    heads = heads.groupBy("id").agg(F.min("h").alias("h"))
    n = F.length("text").cast("long")
    k = F.floor(n / part).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - k).cast("int")), F.coalesce(F.substring("h.head", F.lit(1), k), F.lit("")))
    out = texts.join(heads, "id", "left").unionByName(whole.where("id is null"), allowMissingColumns=True)
    out = out.select("id", n.alias("n"), "fp", F.col("h.next_fp").alias("next_fp"), edited.alias("edited"))
    out = out.select("id", "n", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return out.select("id", F.col("n").alias("n_chars"), "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op1(spark, sf_dir):
    return compare_edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
