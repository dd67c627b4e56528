"""Near-duplicate groups by SimHash and deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most four bits, cut into
three segments, differ in at most one bit of some segment; more bits take more
segments. So each fingerprint is indexed under 64 keys: for every bit, its
segment without that bit. An equality join on the keys finds every pair of
interest.

``near_duplicates`` links by differing bits. ``near_copies`` links by the
Jaccard similarity of shingles: it indexes a wide print, several independent
fingerprints, the same way, and verifies each pair that meets in any of them.

Edge cases: a null or blank text has no words and gets fingerprint zero; a
text of fewer than four words has one shingle, its whole word sequence; equal
texts are one node of the graph; rows that share an id are kept as they are
(each gets its own fingerprint, and the id counts once); null ids take part
and are never the smallest id unless a group has no other; an empty table
gives an empty table. Only the named columns are read, so further columns
can't clash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_words, store, text_key, text_slices
from .graph import components

BITS = 64
SEED = 42
FACTOR, FACTOR2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Of near copies by similarity: words of a wide print. The first SHORT are of
#: pairs of words, of which scattered edits change fewer; the others of the
#: shingles that similarity is measured by, which texts of few words differ in.
PRINTS, SHORT, PRINT_SIZE = 6, 4, 2
#: Each word is indexed for so many differing bits, in three segments.
KEYED = 5
#: Bits that may differ in the word by which a pair was met, and in all: at a
#: similarity of 0.8 a bit differs with probability 0.15 at the most, so that a
#: pair is ruled out by the first in 1 case of 300 a word, by the second in 1 of 10^8.
WORD_BITS, WIDE_BITS = 14, 102
#: Bits of an odd sketch, one for each class of shingles, and the bits below 32 of a shingle's hash that name its class.
SKETCH, CLASS = 512, 9
#: Eighths of all shingles (by hash, from and below) whose holders are counted in turn.
EIGHTHS = ((0, 3), (3, 6), (6, 8))
#: Rows of eight bytes up to which nodes are broadcast.
MAX_BROADCAST = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs in one bit at most."""
    n = distance // 2 + 1
    ends = [BITS * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words; repeats included."""
    ws = text.translate(LOWER).split()
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def simhash(text: bytes, size: int = 4) -> int:
    """Fingerprint of one text: a bit is 1 if set in over half the hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): each document's fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _keys(distance: int):
    """The 64 one-wildcard segment variants of column fp, the wildcard's place in the high bits."""
    out = []
    for at, n in segments(distance):
        seg = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
        out += [seg.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << i))).bitwiseOR(F.lit((at + i) << 32)) for i in range(n)]
    return F.explode(F.array(*out)).alias("key")


def _segments(distance: int, flipped: bool = False):
    """Column fp's segments as they are, the segment's number in the high bits; ``flipped``: also with each bit flipped."""
    out = []
    for k, (at, n) in enumerate(segments(distance)):
        seg = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).bitwiseOR(F.lit(k << 32))
        out += [seg, *[seg.bitwiseXOR(F.lit(1 << i)) for i in range(n if flipped else 0)]]
    return F.explode(F.array(*out)).alias("key")


def _near(a: str, b: str, most: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def bucket_neighbours(fps: DataFrame, distance: int, most: int, node: str = "fp", whole: bool = False) -> DataFrame:
    """(u, v): nodes of (fp, node) whose fingerprints are neighbours in a bucket, or one of them its smallest, at most ``most`` bits apart.

    This joins large groups of near copies without their pairs. ``whole``: in
    the buckets of equal segments only, one for 21; what these leave apart is
    left to ``bucket_pairs``.
    """
    own = F.struct("fp", F.col(node).alias("node"))
    w = Window.partitionBy("key").orderBy("own")
    near = fps.select(_segments(distance) if whole else _keys(distance), own.alias("own")).select("own", F.lag("own").over(w).alias("prev"), F.first("own").over(w).alias("first"))
    near = near.select("own", F.explode(F.array("prev", "first")).alias("other")).select("own.*", F.col("other.fp").alias("fp2"), F.col("other.node").alias("v"))
    return near.where((F.col("node") != F.col("v")) & _near("fp", "fp2", most)).select(F.col("node").alias("u"), "v").distinct()


def bucket_pairs(labelled: DataFrame, distance: int, most: int, node: str = "fp", bound: float | None = None) -> DataFrame:
    """(lu, lv, u, v): all pairs of nodes of a bucket of (fp, node, label) whose labels lu and lv differ, at most ``most`` bits apart.

    They are compared in the join's condition, so none within a group is
    emitted. A bucket of one label is left out, and one side leaves out the
    bucket's label with the most nodes in all: a pair with one side in it comes
    once, any other twice, and a large group isn't compared with itself. The
    labels of a bucket are reduced and stored before the index
    meets them, and both sides of the pairs' join come from exchanges of their
    own, so that Spark can split a bucket of very many rows in either join.
    With ``bound``, see ``probed_pairs``.
    """
    sizes = store(labelled.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    ranked = labelled.join(sizes, "label")
    if bound is not None:
        return probed_pairs(ranked, distance, most, node, bound)
    ranked = ranked.select(_keys(distance), F.struct("size", "label").alias("rank"), "fp")
    mixed = ranked.groupBy("key").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
    # Two rows that are too far apart, as nearly all are that share a key by chance, are told by the bits that not both have.
    mixed = mixed.where((F.col("lo") != F.col("hi")) & ((F.col("n") > 2) | _near("any", "all", most)))
    mixed = store(mixed.select("key", F.col("hi.label").alias("most")), "mixed")
    index = labelled.select(_keys(distance), *dict.fromkeys(["fp", "label", node])).join(mixed, "key")
    # Another name for a key: the join below deals the rows anew.
    index = index.withColumn("key", F.col("key").bitwiseXOR(F.lit(1)))
    side = lambda df, x: df.select(F.col("key").alias(f"k{x}"), F.col("fp").alias(f"f{x}"), F.col("label").alias(f"l{x}"), F.col(node).alias(x))
    a, b = side(index.where("label <> most"), "u"), side(index, "v")
    return a.join(b, (F.col("ku") == F.col("kv")) & (F.col("lu") != F.col("lv")) & _near("fu", "fv", most)).select("lu", "lv", "u", "v")


def probed_pairs(ranked: DataFrame, distance: int, most: int, node: str, bound: float) -> DataFrame:
    """The pairs of ``bucket_pairs`` of (fp, node, label, size of the label, n, level, sketch), but for those that can't have a similarity of ``bound``.

    Segments that differ in no bit or one are found from one side: a node is in
    the buckets of its own segments, and asks in those and in the ones that a
    flipped bit leads to. Of two groups the smaller asks, so that each pair
    comes once a segment and members of the largest group never ask. A bucket
    tells which bits all or none of its nodes have; a question that these put
    too far away, as nearly all are by chance, is dropped before anything wide
    meets it. Counts and odd sketches rule out nearly all others that are less
    alike than ``bound`` before they are emitted: copies of one text that are
    alike to it but not to each other.
    """
    ranked = ranked.withColumn("rank", F.struct("size", "label"))
    buckets = ranked.select(_segments(distance), "rank", "fp").groupBy("key").agg(F.max("rank").alias("hi"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
    buckets = store(buckets, "buckets")
    # Bits that the node has and none of the bucket, or all of the bucket and not the node.
    apart = F.bit_count((F.col("fp").bitwiseAND(F.bitwise_not("any"))).bitwiseOR(F.bitwise_not("fp").bitwiseAND(F.col("all"))))
    # Merged whatever the size, so that what a small input shows of the disk holds for a large one.
    asked = ranked.select(_segments(distance, flipped=True), node, "rank", "fp").join(buckets.hint("merge"), "key").where((F.col("rank") < F.col("hi")) & (apart <= most))
    # What is wide joins a node once, not each of its questions.
    wide = ["fp", "rank", "n", "level", "sketch"]
    asked = asked.groupBy(node).agg(F.collect_list(F.struct("key")).alias("keys")).join(ranked.select(node, *wide), node).select(node, *wide, F.inline("keys"))
    side = lambda df, x: df.select(F.col("key").alias(f"k{x}"), F.col(node).alias(x), F.col("fp").alias(f"f{x}"), *[F.col(c).alias(f"{c}_{x}") for c in wide[1:]])
    a, b = side(asked, "u"), side(ranked.select(_segments(distance), node, *wide), "v")
    near = (F.col("ku") == F.col("kv")) & (F.col("rank_u") < F.col("rank_v")) & _near("fu", "fv", most) & may_be_alike(bound)
    return a.join(b, near).select(F.col("rank_u.label").alias("lu"), F.col("rank_v.label").alias("lv"), "u", "v")


def link(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to (node, root); one without a link is its own root.

    First neighbours in a bucket are linked, then all pairs of a bucket whose
    groups still differ.
    """
    first = store(components(bucket_neighbours(fps, distance, distance)), "groups")
    labelled = fps.join(first, fps.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("label"))
    second = store(components(bucket_pairs(labelled, distance, distance).select(F.col("lu").alias("u"), F.col("lv").alias("v"))), "groups")
    return labelled.join(second, labelled.label == second.node, "left").select(F.col("fp").alias("node"), F.coalesce("root", "label").alias("root"))


def smallest_ids(rows: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id): the smallest id of ``rows`` (id, key) that each key of ``roots`` (node, root) reaches.

    Keys and groups may be hot: both are reduced and stored before they meet,
    so that the joins can be split.
    """
    own = store(rows.groupBy(F.col(key).alias("node")).agg(F.min("id").alias("id")), "own-ids")
    # Keys that roots doesn't have are their own root.
    rooted = store(own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id"), "rooted")
    least = store(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return store(rooted.join(least, "root").select(F.col("node").alias(key), "component_id"), "smallest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links."""
    fps = store(fingerprints(docs, id_col, text_col, size), "fingerprints")
    roots = store(link(fps.select("fp").distinct(), distance), "roots")
    return fps.join(smallest_ids(fps, "fp", roots), "fp").select("id", "fp", "component_id")


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes; fewer words are one run; none has none."""
    n = max(len(h) - size + 1, min(len(h), 1))
    out = h[:n].copy()
    for k in range(1, min(size, len(h))):
        out *= np.uint64(FACTOR)
        out += h[k : k + n]
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(FACTOR2)
    x ^= x >> np.uint64(29)
    x *= np.uint64(FACTOR)
    return x ^ (x >> np.uint64(32))


def wide_print(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """PRINTS words of 64 bits: SimHashes of distinct hashes, each mixed anew for every word."""
    out = np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS):
        hashes = short if k < SHORT else long
        x = _mixed(hashes + np.uint64((k + 1) * FACTOR2 % (1 << 64)))
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(x), 1 << 14):
            counts += np.unpackbits(x[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def sketch_level(n: int) -> int:
    """The level at which a set of ``n`` is sketched: one element in 2^level counts, SKETCH at most on average."""
    return max(0, (n - 1).bit_length() - CLASS) if n else 0


def odd_sketch(hashes: np.ndarray, bound: float) -> np.ndarray:
    """A bit for each class of the set ``hashes`` (32 bits each): whether it has an odd number of elements.

    The bits in which two sets differ are no more than the elements that only
    one has. Large sets are sampled by hash; one that may be alike to a set of
    a higher level has its sketch of that level, too.
    """
    out = []
    for k in range(sketch_level(len(hashes)), sketch_level(int(len(hashes) / bound) + 1) + 1):
        kept = hashes[(hashes >> np.uint32(CLASS)) & np.uint32((1 << k) - 1) == 0]
        odd = np.bincount((kept & np.uint32(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
    return np.concatenate(out)


def may_be_alike(bound: float):
    """Whether nodes u and v (n_u, level_u, sketch_u and so on) may have a similarity of ``bound``, by counts and odd sketches.

    Counts, and sketches of whole sets, rule out no pair that is alike; sketches
    of samples rule out what is four deviations beyond the most expected.
    """
    words = SKETCH // 64
    top = F.greatest("level_u", "level_v")
    word = lambda x, i: F.get(f"sketch_{x}", (top - F.col(f"level_{x}")) * words + i)
    differ = sum((F.bit_count(word("u", i).bitwiseXOR(word("v", i))) for i in range(1, words)), F.bit_count(word("u", 0).bitwiseXOR(word("v", 0))))
    # So many elements, at the most, are in one set only.
    most = (1 - bound) / (1 + bound) * (F.col("n_u") + F.col("n_v")) / F.pow(F.lit(2.0), top)
    expected = SKETCH / 2 * (1 - F.exp(-2 / SKETCH * most))
    allowed = F.when(top == 0, most + 1e-6).otherwise(expected + 4 * F.sqrt(expected) + 4)
    return (F.least("n_u", "n_v") >= bound * F.greatest("n_u", "n_v")) & (differ <= allowed)


def _describe(batches, size: int, bound: float):
    """Rows of ``described`` from whole texts (columns id, text, text_key)."""
    for b in batches:
        for lo, hi in text_slices(b.column(1), 1 << 20):
            c = b.slice(lo, hi - lo)
            words, codes, counts = split_words(pc.ascii_lower(c.column(1)))
            known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
            sets, prints = [], []
            with np.errstate(over="ignore"):
                for h in np.split(known[codes], np.cumsum(counts)[:-1]):
                    shingles = np.unique(rolling(h, size))
                    sets.append(np.unique((shingles >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                    prints.append(wide_print(np.unique(rolling(h, PRINT_SIZE)), shingles))
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets))
            levels = np.fromiter(map(sketch_level, n.tolist()), np.int32, len(sets))
            sketches = [odd_sketch(x.view(np.uint32), bound) for x in sets]
            cols = [
                c.column(0), c.column(2), pa.array(nodes.view(np.int64)), pa.array(n),
                pa.ListArray.from_arrays(np.arange(0, PRINTS * len(sets) + 1, PRINTS, dtype=np.int32), np.concatenate(prints).view(np.int64)),
                pa.array(levels),
                pa.ListArray.from_arrays(np.cumsum([0, *map(len, sketches)]).astype(np.int32), np.concatenate(sketches)),
                pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), np.concatenate(sets)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text_key", "node", "n", "prints", "level", "sketch", "hashes"])


def described(docs: DataFrame, id_col: str, text_col: str, size: int, bound: float) -> DataFrame:
    """One row per row of ``docs``: id, text_key, node, n, prints, level, sketch, hashes.

    Hashes are 32 bits of each distinct shingle of ``size`` words; node stands
    for the set of them; prints has SimHashes of the distinct pairs of words and of these shingles;
    sketch is the set's odd sketch, from its level on.
    """
    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text_key(F.col(text_col).cast("string")).alias("text_key"))
    return src.mapInArrow(lambda it: _describe(it, size, bound), "id long, text_key long, node long, n int, prints array<long>, level int, sketch array<long>, hashes array<int>")


def of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (node, distinct and stored; eight bytes each, counted first)."""
    nodes = nodes.select("node")
    return rows.join(F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST else nodes, "node", "left_semi")


def rivals(rows: DataFrame, bound: float) -> DataFrame:
    """(node, n, own): the nodes of ``rows`` (node, n, hashes) but for those that so many shingles of their own show to be alike to none.

    A shingle is a node's own if no other node has it that is still there; who
    has more than 1 - ``bound`` of them shares too few with any. A part of all
    shingles after the other is counted, so that most nodes are gone after the
    first and little is on disk. This loses no pair: while both of its nodes
    are there, what they share is neither's own.
    """
    left = store(rows.select("node", "n", F.lit(0).cast("long").alias("own")).distinct(), "left")
    for k, (lo, hi) in enumerate(EIGHTHS):
        held = (of_nodes(rows, left) if k else rows).select("node", F.explode("hashes").alias("h"))
        held = held.where(F.pmod("h", F.lit(8)).between(lo, hi - 1)).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
        own = held.where("node = other").groupBy("node").agg(F.count("*").alias("more"))
        left = left.join(own, "node", "left").select("node", "n", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"))
        left = store(left.where(F.col("n") - F.col("own") >= bound * F.col("n") - 1e-6), "left")
    return left


def alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, bound: float) -> DataFrame:
    """The distinct pairs (u, v) of nodes whose sets have a Jaccard similarity of ``bound`` or more.

    Counts, wide prints and odd sketches rule most others out before the sets are read.
    """
    own = lambda x: nodes.select(F.col("node").alias(x), F.col("prints").alias(f"p_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "level", "sketch")])
    apart = F.aggregate(F.zip_with("p_u", "p_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    pairs = pairs.join(own("u"), "u").join(own("v"), "v").where((apart <= WIDE_BITS) & may_be_alike(bound))
    pairs = store(pairs.select("u", "v", "n_u", "n_v"), "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = store(of_nodes(rows.select("node", "hashes"), asked).groupBy("node").agg(F.first("hashes").alias("h")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("h").alias("h_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("h").alias("h_v")), "v")
    common = F.size(F.array_intersect("h_u", "h_v"))
    return both.withColumn("common", common).where(F.col("common") >= bound * (F.col("n_u") + F.col("n_v") - F.col("common"))).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bound: float = 0.8) -> DataFrame:
    """(id, text_key, component_id): component_id is the smallest id reachable by links.

    Two texts are linked where the Jaccard similarity of their sets of
    ``size``-word shingles is ``bound`` or more. Texts of one set are one node.
    Nodes that their own shingles show to be alike to none go first
    (``rivals``). Of the others, pairs to verify come from the
    segments of each of the PRINTS words of a wide print: neighbours in buckets
    of all words first, then, once the groups that these make are known, all
    pairs across groups. All of them are indexed by all their words, whoever shares them.
    """
    rows = store(described(docs, id_col, text_col, size, bound), "shingles")
    nodes = store(of_nodes(rows, rivals(rows, bound)).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prints", "level", "sketch")]), "nodes")

    def by_word(find, df: DataFrame, name: str) -> DataFrame:
        """Pairs of nodes from the index of one word after the other, so that only one is on disk."""
        found = None
        for k in range(PRINTS):
            word = df.withColumn("fp", F.get("prints", F.lit(k))).drop("prints")
            own = store(find(word, KEYED, WORD_BITS, "node").select("u", "v"), name)
            found = own if found is None else found.union(own)
        return found

    first = store(alike(by_word(partial(bucket_neighbours, whole=True), nodes, "neighbours"), nodes, rows, bound), "links")
    roots = store(components(first), "groups")
    labelled = store(nodes.join(roots, "node", "left").select("node", "n", "prints", "level", "sketch", F.coalesce("root", "node").alias("label")), "labelled")
    second = alike(by_word(partial(bucket_pairs, bound=bound), labelled, "across"), nodes, rows, bound)
    roots = store(components(store(second.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "links")), "groups")
    return rows.select("id", "text_key", "node").join(smallest_ids(rows, "node", roots), "node").select("id", "text_key", "component_id")


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
