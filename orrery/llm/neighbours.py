"""Approximate nearest neighbours by collision counting over sorted projections.

Every vector is projected on PROJECTIONS random lines, and each line keeps the
vectors of a shard in the order of their projections. A query looks at windows
of these arrays that are centred on its own projections. Windows start narrow
and widen by FACTOR, which is a rehashing without new tables: a window of
another width is another part of the same array. A vector that lies in the
windows of enough lines has collided often enough and is verified by its
distance. Windows stop widening once they are as wide as the distance of the
K-th neighbour asks for.

A vector at exactly the radius of a window falls into one with probability
P_HIT, and into at least NEEDED of PROJECTIONS with probability 0.99; nearer
ones more often. The radius at which a query stops is at least the distance of
the last neighbour it returns.

How wide windows may get for a query is bounded by its distances to a sample of
SAMPLE vectors; the sample bounds radii only, every vector is indexed. Shards
hold at most SHARD vectors, dealt by hash, and every query visits every shard
of vectors of its length, so that no bucket can be hot and nothing is capped.

Vectors that are null, empty or zero, or hold null or non-finite components,
take no part; vectors of other lengths than a query's aren't among its
candidates. With the nearest of the sample every query gets K neighbours. Rows are told apart by themselves: equal ids are different rows,
and a query leaves out its own row only. A null id is never a query, and comes
last among equal distances. A query with fewer candidates than K gets all of
them. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, store, table

#: Lines, and of how many windows a vector must lie in to be verified.
PROJECTIONS = 48
#: Half the width of a window over its radius, and how likely a vector at the radius lies in it: P(|N(0, 1)| <= HALF).
HALF = 1.0
P_HIT = math.erf(HALF / math.sqrt(2))
NEEDED = math.floor(PROJECTIONS * P_HIT - 2.5 * math.sqrt(PROJECTIONS * P_HIT * (1 - P_HIT)))
#: Windows widen by this factor from the bound of a query over FACTOR ** STEPS up to the bound.
FACTOR, STEPS = 1.3, 8
#: Vectors of a shard at the most, vectors of the sample, and queries taken together.
SHARD, SAMPLE, TOGETHER = 1 << 16, 1024, 256
SEED = 42


def lines(dim: int) -> np.ndarray:
    """(dim, PROJECTIONS) standard normal directions, the same for every shard."""
    return np.random.default_rng(SEED + dim).standard_normal((dim, PROJECTIONS))


def distances(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - q) ** 2).sum(axis=1))


class Shard:
    """The vectors of one shard: for each line, their projections in order, and which vector each is of."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        shadow = (vectors @ lines(vectors.shape[1])).T
        self.order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order, axis=1)
        # What rounding may move a projection by.
        self.slack = 1e-9 * (1 + np.abs(self.sorted).max(initial=0.0))

    def search(self, row: int, q: np.ndarray, shadow: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the nearest verified vectors, nearest first, ties to the smaller id."""
        n = len(self.rows)
        counts, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        verified[self.rows == row] = True
        lo = hi = None
        places, found = np.empty(0, np.int64), np.empty(0)
        radii = [bound / FACTOR**t for t in range(STEPS, -1, -1)] if math.isfinite(bound) else [math.inf]
        for radius in radii:
            reach = HALF * radius + self.slack
            left = np.array([s.searchsorted(p - reach, "left") for s, p in zip(self.sorted, shadow)])
            right = np.array([s.searchsorted(p + reach, "right") for s, p in zip(self.sorted, shadow)])
            # Only what the wider windows add is counted.
            if lo is None:
                parts = [o[a:b] for o, a, b in zip(self.order, left, right)]
            else:
                parts = [o[a:b] for o, a, b in zip(self.order, left, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, right)]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            lo, hi = left, right
            fresh = np.flatnonzero((counts >= NEEDED) & ~verified)
            verified[fresh] = True
            places, found = np.concatenate((places, fresh)), np.concatenate((found, distances(q, self.vectors[fresh])))
            best = np.lexsort((self.ids[places], found))[:k]
            places, found = places[best], found[best]
            if len(found) == k and found[-1] <= radius:
                break
        return places, found


def _search(batches, k: int):
    """Answers from rows (cell, query, row, id, vector, bound), sorted so that the vectors of a cell come before its queries."""
    cell, shard, gathered = None, None, []

    def answers(rows):
        nonlocal shard
        if shard is None and gathered:
            shard = Shard(*(np.concatenate(x) for x in zip(*gathered)))
        out = []
        if shard is not None:
            shadows = np.stack(rows["vector"]) @ lines(len(rows["vector"][0]))
            for row, qid, q, s, bound in zip(rows["row"], rows["id"], rows["vector"], shadows, rows["bound"]):
                places, found = shard.search(row, q, s, bound, k)
                out.append((np.full(len(found), row), np.full(len(found), qid), shard.rows[places], shard.ids[places], found))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0)]
        cols = [pa.array(c.astype(np.int64)) for c in cols[:3]] + [pa.array(cols[3].astype(np.int64), mask=cols[3] == NO_ID), pa.array(cols[4])]
        return pa.RecordBatch.from_arrays(cols, ["row", "query_id", "other", "vec_id", "score"])

    for b in batches:
        cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
            if lo == hi:
                continue
            if cells[lo] != cell:
                cell, shard, gathered = cells[lo], None, []
            c = b.slice(lo, hi - lo)
            vectors = c.column(4).flatten().to_numpy().reshape(hi - lo, -1)
            row, ids = c.column(2).to_numpy(), c.column(3).fill_null(NO_ID).to_numpy()
            if not kinds[lo]:
                gathered.append((row, ids, vectors.copy()))
                continue
            bounds = c.column(5).to_numpy(zero_copy_only=False)
            for at in range(0, hi - lo, TOGETHER):
                part = slice(at, at + TOGETHER)
                yield answers({"row": row[part], "id": ids[part], "vector": vectors[part], "bound": bounds[part]})


#: Stands for a null id inside tasks: after all others.
NO_ID = np.iinfo(np.int64).max


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, dim, vector) of the vectors that take part; row is a number of the row's own."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return out.where(whole & F.exists("vector", lambda x: x != 0)).select("row", "id", F.size("vector").alias("dim"), "vector")


def with_bounds(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """``queries`` with the ``k`` nearest of the sample's vectors of the same length (near), and the distance of the last of them (bound), infinite if there are fewer."""
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r)
    sides = {d: (np.array([r["row"] for r in x]), np.array([NO_ID if r["id"] is None else r["id"] for r in x]), np.array([r["vector"] for r in x])) for d, x in by_dim.items()}
    kind = pa.list_(pa.struct([("other", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            bounds, nears = [], []
            for row, v in zip(b.column(0).to_pylist(), b.column(3)):
                q = v.values.to_numpy()
                rows, ids, known = sides.get(len(q), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(q)))))
                found = distances(q, known)
                best = [i for i in np.lexsort((ids, found))[: k + 1].tolist() if rows[i] != row][:k]
                nears.append([{"other": int(rows[i]), "vec_id": None if ids[i] == NO_ID else int(ids[i]), "score": float(found[i])} for i in best])
                bounds.append(float(found[best[-1]]) if len(best) == k else math.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bounds, pa.float64()), pa.array(nears, kind)], [*b.schema.names, "bound", "near"])

    return queries.mapInArrow(run, "row long, id long, dim int, vector array<double>, bound double, near array<struct<other:long,vec_id:long,score:double>>")


def nearest(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which the column ``is_query`` holds.

    ``is_query`` is a column over id. score is the Euclidean distance.
    """
    rows = store(vectors_of(df, id_col, vector_col), "vectors")
    total = rows.count()
    shards = max(shuffle_partitions(df.sparkSession), -(-total // SHARD))
    # A bounded sample, the same in every run: the rows with the smallest hashes.
    sample = rows.orderBy(F.xxhash64("vector", "row")).limit(SAMPLE).select("row", "id", "vector").collect()
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long")
    # Vectors of one length and shard are a cell.
    cell = lambda s: F.col("dim").cast("long") * F.lit(1 << 32) + s
    held = rows.select(cell(shard).alias("cell"), F.lit(False).alias("query"), "row", "id", "vector", F.lit(None).cast("double").alias("bound"))
    queries = store(with_bounds(rows.where(F.coalesce(is_query, F.lit(False))), sample, k), "queries")
    asked = queries.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    asked = asked.select(cell(F.col("s")).alias("cell"), F.lit(True).alias("query"), "row", "id", "vector", "bound")
    dealt = held.union(asked).repartitionById(shards, F.pmod("cell", F.lit(1 << 32)).cast("int")).sortWithinPartitions("cell", "query")
    found = dealt.mapInArrow(lambda it: _search(it, k), "row long, query_id long, other long, vec_id long, score double")
    # The sample's nearest are known already; with them no query has fewer than k.
    known = queries.select("row", F.col("id").alias("query_id"), F.inline("near"))
    found = found.union(known).repartition("row").dropDuplicates(["row", "other"])
    best = Window.partitionBy("row").orderBy("score", F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op12(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
