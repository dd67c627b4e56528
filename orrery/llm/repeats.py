"""Substring deduplication with fixed-block anchors.

A window of 13 words holds exactly one whole block of 7 when a document is
cut into blocks of 7 from its start. So the blocks of all documents, one word
in seven, are indexed, and every rolling run of 7 words of every document
probes the index. A probe that meets a block of a document with a smaller id
is a hit. Only windows around hits, on both sides, are looked at further:
they are compared whole, by 128 bits of their words' hashes, which extends
each hit to the maximal exact repeats that contain it, and each word covered
by a window that also starts in a document with a smaller id is removed.

Hashes travel in packed blocks, dealt over partitions by hash value; a task
holds its partition's share of the index and streams the probes. What very
many documents share is settled where they are: within a slice of texts, runs
behind a block of a smaller id are hits already, and windows behind an equal
one of a smaller id go already. Of such runs and windows only those of the
slice's smallest id travel (and of the runs the one of the largest, by which
the blocks of other slices learn that they are met).

Edge cases: a null text has no words; fewer than 13 words make no window, so
nothing goes; a window of the same id is no smaller one; rows with a null id come
after all others; rows that share an id, or have none, are told apart by a
hash of their text, and each loses only words of its own windows; an empty
table gives an empty table. Only the named columns are read, so further
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, split_words, store, text_key, text_slices

WINDOW = 13
LAST = (1 << 63) - 1
#: 16-bit cells of a run's hash: a false hit costs a look at its windows, which keep 128 bits.
RUN_CELLS, WINDOW_CELLS = 3, 8
#: Text of which a partition of the exchange takes the hashes.
TEXT_EACH = 64 << 20
#: Kinds of packed rows, in the order in which a task wants them.
BLOCKS, ASKED, SETTLED = 0, 1, 2
PACKED = "part int, kind int, n int, hashes binary, ids binary, places binary"
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` hashes: a polynomial, then mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, size):
            out *= np.uint64(factor)
            out += h[k : k + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9FB21C651E98DF25)
        return out ^ (out >> np.uint64(29))


def _slices(batches, seeds):
    """(rows, keys, doc, place, hashes) of slices of texts (columns id, text, text_key).

    Keys are (id, text key) of each text; then, for every word in turn, its
    text, its place there and a hash of it for each seed.
    """
    for b in batches:
        for lo, hi in text_slices(b.column(1)):
            c = b.slice(lo, hi - lo)
            words, codes, counts = split_words(c.column(1))
            words = words.cast(pa.binary()).to_pylist()
            hashes = [np.fromiter((xxhash.xxh64_intdigest(w, s) for w in words), np.uint64, len(words))[codes] for s in seeds]
            doc = np.repeat(np.arange(len(counts)), counts)
            yield c, np.stack([c.column(i).to_numpy() for i in (0, 2)], axis=1), doc, np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc], hashes, counts


def _cells(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint16).reshape(len(h), -1)


def _dealt(parts: int, kind: int, part: np.ndarray, cells: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Packed rows of one slice, one for each partition: hashes, keys as runs (keys, then lengths), and places."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    for at, end in enumerate(ends.tolist()):
        own = order[ends[at - 1] if at else 0 : end]
        if len(own):
            d, p = doc[own], place[own]
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            lengths = np.diff(np.append(first, len(d))).astype(np.int32)
            small = np.uint16 if p.max() < 1 << 16 else np.int32
            yield at, kind, len(own), cells[own].tobytes(), keys[d[first]].tobytes() + lengths.tobytes(), p.astype(small).tobytes()


def _batches(rows):
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    rows = list(rows)
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 256]), kinds)], ["part", "kind", "n", "hashes", "ids", "places"])


def _rows(batches, cells: int):
    """(kind, hashes, keys, places) of each packed row; hashes as columns of 64 bits."""
    for b in batches:
        for i in range(b.num_rows):
            kind, n, hashes, ids, places = (b.column(c)[i].as_py() for c in range(1, 6))
            h = np.frombuffer(hashes, np.uint16).reshape(n, -1) if hashes else np.zeros((n, cells), np.uint16)
            if cells % 4:
                h = np.concatenate((h, np.zeros((n, 4 - cells % 4), np.uint16)), axis=1)
            runs = len(ids) // 20
            keys, lengths = np.frombuffer(ids[: 16 * runs], np.int64).reshape(-1, 2), np.frombuffer(ids[16 * runs :], np.int32)
            at = np.frombuffer(places, np.uint16 if len(places) == 2 * n else np.int32)
            yield kind, np.ascontiguousarray(h).view(np.uint64), np.repeat(keys, lengths, axis=0), at.astype(np.int32)


def _places(keys: np.ndarray, places: np.ndarray):
    for at in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[at : at + 100_000, k]) for k in (0, 1)), pa.array(places[at : at + 100_000].astype(np.int32))], ["id", "text_key", "place"])


def _least(h: np.ndarray, ids: np.ndarray):
    """Row order by (hash columns, id), group number of each row in it, least id of each group."""
    order = np.lexsort((ids, *h.T[::-1]))
    h, ids = h[order], ids[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1))) if len(h) else np.empty(0, bool)
    return order, np.cumsum(new) - 1, ids[new]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % parts


def _runs(batches, parts: int, block: int):
    """Packed blocks and runs of whole texts."""
    for turn, (_, keys, doc, place, (h,), counts) in enumerate(_slices(batches, (0,))):
        h = rolling(h, block, FACTORS[0])
        n = counts[doc[: len(h)]]
        whole = (n - place[: len(h)] >= block) & (n >= WINDOW)
        h, d, p = h[whole], doc[: len(h)][whole], place[: len(h)][whole]
        if not len(h):
            continue
        ids = keys[d, 0]
        b = np.flatnonzero(p % block == 0)
        order, group, least = _least(h[b, None], ids[b])
        # One block for each hash: that of the smallest id.
        b = b[order[np.flatnonzero(np.diff(group, prepend=-1))]]
        at = np.minimum(np.searchsorted(h[b], h), len(b) - 1)
        settled = np.flatnonzero((h[b][at] == h) & (least[at] < ids))
        last = np.lexsort((ids[settled], at[settled]))
        last = settled[last[np.flatnonzero(np.diff(at[settled][last], append=-1))]]
        asked = np.ones(len(h), bool)
        asked[settled] = False
        asked[last] = True
        asked = np.flatnonzero(asked)
        cells, part = _cells(h)[:, :RUN_CELLS], _part(h, parts)
        for kind, own in ((BLOCKS, b), (ASKED, asked)):
            yield from _batches(_dealt(parts, kind, part[own], cells[own], keys, d[own], p[own]))
        yield from _batches(_dealt(parts, SETTLED, np.full(len(settled), turn % parts), np.empty((len(settled), 0), np.uint16), keys, d[settled], p[settled]))


def _match(batches):
    """Hits from one partition's blocks and then its runs: (id, text key, place) on both sides."""
    held: list = [[], [], []]
    index = None

    def build():
        h, keys, places = (np.concatenate(x) if x else e for x, e in zip(held, (np.empty((0, 1), np.uint64), np.empty((0, 2), np.int64), np.empty(0, np.int32))))
        order, group, least = _least(h, keys[:, 0])
        first = h[order, 0][np.flatnonzero(np.diff(group, prepend=-1))]
        return first, least, group, keys[order], places[order], np.zeros(len(least), bool)

    for kind, h, keys, places in _rows(batches, RUN_CELLS):
        if kind == BLOCKS:
            for x, v in zip(held, (h, keys, places)):
                x.append(v)
            continue
        if kind == SETTLED:
            yield from _places(keys, places)
            continue
        if index is None:
            index = build()
            held = [[], [], []]
        first, least, _, _, _, met = index
        if len(first):
            at = np.minimum(np.searchsorted(first, h[:, 0]), len(first) - 1)
            hit = (first[at] == h[:, 0]) & (least[at] < keys[:, 0])
            met[at[hit]] = True
            yield from _places(keys[hit], places[hit])
    if index is not None:
        _, _, group, keys, places, met = index
        yield from _places(keys[met[group]], places[met[group]])


def _around(batches, parts: int, block: int):
    """Packed windows of 13 around hits (columns id, text, text_key, places)."""
    for turn, (c, keys, doc, place, hashes, counts) in enumerate(_slices(batches, (0, 1))):
        starts = np.cumsum(counts) - counts
        lists = c.column(3)
        hit = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        hit_doc = doc[hit]
        near = np.zeros(len(doc) + 1, np.int32)
        np.add.at(near, np.maximum(hit - (WINDOW - block), starts[hit_doc]), 1)
        np.add.at(near, hit + 1, -1)
        n = max(len(doc) - WINDOW + 1, 0)
        at = np.flatnonzero((np.cumsum(near)[:n] > 0) & (counts[doc[:n]] - place[:n] >= WINDOW))
        if not len(at):
            continue
        both = np.stack([rolling(h, WINDOW, f)[at] for h, f in zip(hashes, FACTORS)], axis=1)
        d, p = doc[at], place[at]
        ids = keys[d, 0]
        order, group, least = _least(both, ids)
        late = np.zeros(len(at), bool)
        late[order] = least[group] < ids[order]
        for kind, own in ((ASKED, np.flatnonzero(~late)), (SETTLED, np.flatnonzero(late))):
            cells = _cells(both[own]) if kind == ASKED else np.empty((len(own), 0), np.uint16)
            part = _part(both[own, 0], parts) if kind == ASKED else np.full(len(own), turn % parts)
            yield from _batches(_dealt(parts, kind, part, cells, keys, d[own], p[own]))


def _later(batches):
    """(id, text key, place) of one partition's windows that also start in a document with a smaller id."""
    held: list = [[], [], []]
    for kind, *row in _rows(batches, WINDOW_CELLS):
        if kind == SETTLED:
            yield from _places(*row[1:])
        else:
            for x, v in zip(held, row):
                x.append(v)
    if held[0]:
        h, keys, places = map(np.concatenate, held)
        order, group, least = _least(h, keys[:, 0])
        late = least[group] < keys[order, 0]
        yield from _places(keys[order][late], places[order][late])


def _gathered(places: DataFrame, name: str) -> DataFrame:
    """(id, text_key, ``name``): the places of each text in one array; stored, so that a join with the texts can be split."""
    return store(store(places, "places").groupBy("id", "text_key").agg(F.collect_set("place").alias(name)), name)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 7) -> DataFrame:
    """(id, text_key, starts): where windows of 13 words start that also start in a smaller id."""
    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), text_key(F.col(text_col).cast("string")).alias("text_key"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // TEXT_EACH))
    found = "id long, text_key long, place int"
    dealt = src.mapInArrow(lambda it: _runs(it, parts, block), PACKED).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    hits = _gathered(dealt.mapInArrow(_match, found), "places")
    dealt = src.join(hits, ["id", "text_key"]).select("id", "text", "text_key", "places").mapInArrow(lambda it: _around(it, parts, block), PACKED).repartitionById(parts, F.col("part"))
    return _gathered(dealt.mapInArrow(_later, found), "starts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 7) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): kept words joined by one space; spans are the removed runs of words."""
    starts = repeats(docs, id_col, text_col, block).withColumnsRenamed({"id": "k", "text_key": "t"})
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(text).alias("text"), text_key(text).alias("own"))
    src = src.join(starts, (F.coalesce("id", F.lit(LAST)) == F.col("k")) & (F.col("own") == F.col("t")), "left").select("id", "text", "starts")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                n, gone, spans, kept = [], [], [], []
                for text, starts in zip(c.column(1).cast(pa.binary()), c.column(2)):
                    ws = (text.as_py() or b"").split()
                    n.append(len(ws))
                    if not starts.is_valid:
                        gone.append(0)
                        spans.append([])
                        kept.append(b" ".join(ws))
                        continue
                    edge = np.zeros(len(ws) + 1, np.int64)
                    p = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + WINDOW, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))).tolist()
                    gone.append(int(out.sum()))
                    spans.append([f"{a}:{z}" for a, z in zip(turns[::2], turns[1::2])])
                    kept.append(b" ".join(w for w, x in zip(ws, out.tolist()) if not x))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.string())), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])

    return src.mapInArrow(run, "id long, n_words long, n_removed long, spans array<string>, kept string")


def op5(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
