"""Exact deduplication against immutable snapshots, screened by binary-fuse filters.

A snapshot is a table of digests, each with its smallest id, dealt over
buckets by digest; every bucket has a static binary-fuse filter of eight bits
an entry. A batch's digests go to their bucket, where the filter says "new"
or "maybe seen". Only the latter are joined with the bucket's exact rows, and
the texts of both sides are then compared byte for byte. Digests that occur
more than once within the batch are grouped on their own, by digest.

Edge cases: a null text is an empty one; texts are equal when identical with
each run of ASCII white space as one space; rows that share an id count one
by one, and all of them are kept if their id is the group's smallest; a null
id is never the smallest unless all are null; an empty batch or snapshot is
valid. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, shuffle_partitions, split_points, store

MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: Rows of eight bytes up to which digests are broadcast.
MAX_BROADCAST = 1_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * MIX
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


class FuseFilter:
    """Three-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, count: int):
        """Three cells in adjacent segments, and the fingerprint, of each key."""
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = first * np.uint64(segment)
        cells = [base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * segment) + (_mix(h, 1) & mask)]
        return np.stack(cells).astype(np.int64), (_mix(h, 2) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
        count = max(1, -(-room // segment))
        for seed in range(1, 1000):
            made = cls._peel(keys, seed, segment, count)
            if made is not None:
                return cls(seed, segment, count, made)
            if seed % 10 == 0:
                count += max(1, count // 10)
        raise RuntimeError("no seed peels these keys")

    @classmethod
    def _peel(cls, keys, seed, segment, count):
        """Peel by rounds: all cells with one key left at a time; None if keys remain."""
        size = (count + 2) * segment
        at, prints = cls.places(keys, seed, segment, count)
        alive, order = np.arange(len(keys)), []
        degree = np.bincount(at.ravel(), minlength=size)
        while len(alive):
            lone = degree[at[:, alive]] == 1
            who = lone.any(axis=0)
            if not who.any():
                return None
            free = alive[who]
            cell = at[lone[:, who].argmax(axis=0), free]
            order.append((free, cell))
            np.subtract.at(degree, at[:, free].ravel(), 1)
            alive = alive[~who]
        cells = np.zeros(size, np.uint8)
        for free, cell in reversed(order):
            a, b, c = at[:, free]
            cells[cell] = 0
            cells[cell] = prints[free] ^ cells[a] ^ cells[b] ^ cells[c]
        return cells

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about one other in 256."""
        (a, b, c), prints = self.places(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return prints == self.cells[a] ^ self.cells[b] ^ self.cells[c]


def normalized(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the normalised text in lowercase hex."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalized(F.col(text_col).cast("string")).cast("binary"), 256).alias("digest"))


def _key():
    return F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")


class Snapshot:
    """Digests of a corpus that no longer changes, and a filter for each bucket of them."""

    def __init__(self, rows: DataFrame, filters: DataFrame, buckets: int):
        self.rows, self.filters, self.buckets = rows, filters, buckets

    @classmethod
    def build(cls, seen: DataFrame, buckets: int) -> "Snapshot":
        """``seen`` is (id, digest). Rows: (digest, first_id, n, bucket)."""
        rows = seen.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        rows = store(rows.withColumn("bucket", F.pmod(_key(), F.lit(buckets)).cast("int")), "snapshot")

        def make(batches):
            keys: dict[int, list] = {}
            for b in batches:
                at, k = b.column(0).to_numpy(), b.column(1).to_numpy()
                for x in np.unique(at):
                    keys.setdefault(int(x), []).append(k[at == x])
            for x, parts in keys.items():
                f = FuseFilter.build(np.concatenate(parts))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([x], pa.int32()), "seed": pa.array([f.seed], pa.int32()), "segment": pa.array([f.segment], pa.int32()), "count": pa.array([f.count], pa.int32()), "cells": pa.array([f.cells.tobytes()], pa.binary())})

        parts = shuffle_partitions(rows.sparkSession)
        filters = rows.select("bucket", _key().alias("key")).repartitionById(parts, F.pmod("bucket", F.lit(parts)))
        filters = filters.mapInArrow(make, "bucket int, seed int, segment int, count int, cells binary")
        return cls(rows, store(filters, "filters"), buckets)

    def screen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (digest, ...) that their bucket's filter can't rule out.

        Filters and digests are dealt by bucket, filters first in each task,
        so that a task holds its own buckets' filters and streams the rest.
        """
        cols, parts = batch.columns, shuffle_partitions(batch.sparkSession)
        asked = batch.withColumn("bucket", F.pmod(_key(), F.lit(self.buckets)).cast("int")).withColumn("key", _key())
        rows = self.filters.unionByName(asked, allowMissingColumns=True).repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions(F.col("cells").isNull())
        schema = batch.schema

        def run(batches):
            known: dict[int, FuseFilter] = {}
            for b in batches:
                t = pa.Table.from_batches([b])
                for r in t.filter(t["cells"].is_valid()).to_pylist():
                    known[r["bucket"]] = FuseFilter(r["seed"], r["segment"], r["count"], np.frombuffer(r["cells"], np.uint8))
                t = t.filter(t["cells"].is_null())
                if not t.num_rows:
                    continue
                at, keys, hit = t["bucket"].to_numpy(), t["key"].to_numpy(), np.zeros(t.num_rows, bool)
                for x in np.unique(at):
                    if int(x) in known:
                        own = at == x
                        hit[own] = known[int(x)].holds(keys[own])
                yield from t.select(cols).filter(pa.array(hit)).to_batches()

        return rows.mapInArrow(run, schema)


def same_bytes(old: DataFrame, new: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The digests of ``found``, a stored table, for which a text of either side is equal byte for byte.

    The texts are met by digest, the least of each side, so rows need no id.
    Eight bytes of the digests to look for are counted and broadcast, so that
    only their texts are shuffled; beyond MAX_BROADCAST each side's texts are
    reduced to one a digest first and meet the digests then.
    """
    few = found.count() <= MAX_BROADCAST
    keys = F.broadcast(found.select(_key().alias("key")))

    def texts(docs: DataFrame, name: str) -> DataFrame:
        text = normalized(F.col(text_col).cast("string"))
        rows = docs.select(text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        if few:
            # Others with such a key go when both sides meet: a digest of both is one of ``found``.
            rows = rows.withColumn("key", _key()).join(keys, "key", "left_semi")
        least = rows.groupBy("digest").agg(F.min("text").alias(name))
        return least if few else least.join(found.select("digest").distinct(), "digest")

    return texts(old, "t0").join(texts(new, "t1"), "digest").where("t0 = t1").select("digest")


def deduplicate(batch: DataFrame, snapshot_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 200_000) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for the rows of the batch and of the snapshot.

    The row with the smallest id of equal texts stays, be it old or new.
    """
    spark = batch.sparkSession
    old, new = (store(digests(d, id_col, text_col), "digests") for d in (snapshot_docs, batch))
    snap = Snapshot.build(old, max(1, -(-old.count() // per_bucket), shuffle_partitions(spark)))
    fresh = store(new.groupBy("digest").agg(F.min("id").alias("new_id"), F.count("*").alias("new_n")), "batch")
    maybe = store(snap.screen(fresh), "maybe")
    found = store(maybe.join(snap.rows, "digest").select("digest"), "found")
    both = store(same_bytes(snapshot_docs, batch, found, text_col), "equal")
    groups = snap.rows.select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"))
    joined = fresh.join(both.withColumn("seen", F.lit(True)), "digest", "left").select("digest", F.col("new_id").alias("keep_id"), F.col("new_n").alias("group_size"), F.coalesce("seen", F.lit(False)).alias("seen"))
    merged = groups.union(joined.where("seen").drop("seen")).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).withColumn("with_old", F.lit(True))
    # A batch's text that only shares a digest with an old one is a group of its own.
    alone = joined.where("not seen").drop("seen").withColumn("with_old", F.lit(False))
    rows = old.withColumn("with_old", F.lit(True)).union(new.join(both.withColumn("with_old", F.lit(True)), "digest", "left").select("id", "digest", F.coalesce("with_old", F.lit(False))))
    return rows.join(merged.union(alone), ["digest", "with_old"]).select("id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest")


def op6(spark, sf_dir):
    """Documents with ids up to the median are the snapshot, the rest a new batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = (split_points(docs, "doc_id", 2) or [0])[0]
    out = deduplicate(docs.where(F.col("doc_id") > middle), docs.where(F.coalesce(F.col("doc_id") <= middle, F.lit(True))))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL6 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
