"""Collocations: phrases of two to five words that occur more often than their parts suggest.

Counts are streams in word order. Every place of the corpus gives one row, the
words from it on, up to five; in prefix order (sorted by first word, second
word, ...) the places of every shorter phrase stand together as well, so that
one pass over the sorted stream counts the phrases of all lengths. The
counted phrases are then kept twice, in prefix order and in suffix order (by
last word, last but one, ...): merging the first with the heads of candidates
gives left counts, merging the second with their tails gives right counts, and
each order merged with the phrases one word longer gives extension counts. The
joins are sort-merge joins of sorted streams.

A phrase is a candidate only if each pair of adjacent words in it is as
frequent as a candidate must be. So one pass counts words, and pairs by a hash;
the frequent pairs are folded into a bit map of fixed size, and places where no
frequent pair starts are left out of the stream. A pair let through by chance
only costs time: what it starts is counted by its words and then found rare.

A piece of text has no phrases beyond its punctuation and line ends. All counts
are per language; a null language is ``und``, a null text empty. Equal texts
count as often as they are there. An empty table, or one without a frequent
phrase, gives no rows. Ids aren't read, and further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_small, store, table, text_slices

#: Bytes of text whose places are counted together: what a task holds at once.
SLICE = 1 << 20
#: Words of the longest phrase.
LONGEST = 5
#: Bits of the map of frequent pairs (8 MB), at any size of the input.
MAP_BITS = 1 << 26
#: What splits the rows of a language before its best phrases are taken.
SALTS = 64
WORDS = [f"w{k + 1}" for k in range(LONGEST)]
#: Of a byte: 0 belongs to a word, 1 stands between words, 2 ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _slices(batches):
    """For slices of columns lang, text: (langs, lang of each word, words, word of each place, whether it and the next share a piece)."""
    for b in batches:
        for lo, hi in text_slices(b.column(1), SLICE):
            langs = b.column(0).slice(lo, hi - lo).dictionary_encode()
            texts = pc.ascii_lower(b.column(1).slice(lo, hi - lo))
            joined = pc.binary_join(pa.array([texts.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"\n")
            kind = KIND[np.frombuffer(joined[0].as_buffer(), np.uint8)] if len(texts) else np.empty(0, np.uint8)
            inside = np.concatenate(([False], kind == 0, [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            raw = np.frombuffer(joined[0].as_buffer(), np.uint8)[kind == 0]
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
            coded = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            breaks = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int32)))[starts]
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.searchsorted(np.cumsum(sizes + 1), starts, "right")
            together = np.append(breaks[1:] == breaks[:-1], False)
            yield langs.dictionary, langs.indices.to_numpy()[doc].astype(np.int64), coded.dictionary, coded.indices.to_numpy().astype(np.int64), together


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def _pairs(langs, lang, words, code) -> np.ndarray:
    """A hash of each place's word and the next, and of the language."""
    h = _hashes(words)[code]
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + _hashes(langs)[lang[:-1]]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return np.append(x ^ (x >> np.uint64(29)), np.uint64(0))


def _count(batches):
    """Rows (lang, word, pair, c): of words, of pairs (by hash), and of all words of a language."""
    for langs, lang, words, code, together in _slices(batches):
        at, n = np.unique(lang * len(words) + code, return_counts=True)
        pair, m = np.unique(_pairs(langs, lang, words, code)[together].view(np.int64), return_counts=True)
        every = np.bincount(lang, minlength=len(langs))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(at // len(words))), words.take(pa.array(at % len(words))), none, pa.array(n)], ["lang", "word", "pair", "c"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.utf8()), pa.nulls(len(pair), pa.utf8()), pa.array(pair), pa.array(m)], ["lang", "word", "pair", "c"])
        yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.utf8()), pa.nulls(len(langs), pa.int64()), pa.array(every)], ["lang", "word", "pair", "c"])


def counted(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Frequent words (lang, word) and pairs (pair, a hash), and the number of all words of each language (lang), each with its count c."""
    rows = _texts(docs, text_col, lang_col).mapInArrow(_count, "lang string, word string, pair long, c long")
    rows = rows.groupBy("lang", "word", "pair").agg(F.sum("c").alias("c"))
    return store(rows.where((F.col("c") >= least) | (F.col("word").isNull() & F.col("pair").isNull())), "counted")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def pair_map(pairs: DataFrame) -> np.ndarray:
    """Bit map of the hashes in column pair, as 64-bit words: MAP_BITS bits whatever the input."""
    slot = F.col("pair").bitwiseAND(F.lit(MAP_BITS - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = pairs.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _places(batches, pairs: np.ndarray):
    """Rows (lang, w1 ... w5, c): the words from each place on where a frequent pair may start, and from how many places of a slice."""
    for langs, lang, words, code, together in _slices(batches):
        slot = _pairs(langs, lang, words, code) & np.uint64(MAP_BITS - 1)
        good = together & ((pairs[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(good)
        if not len(at):
            continue
        # Words from each place on, 0 beyond the first pair that isn't frequent.
        w, going = [code[at] + 1, code[at + 1] + 1], np.ones(len(at), bool)
        padded, follows = np.append(code + 1, np.zeros(LONGEST, np.int64)), np.append(good, np.zeros(LONGEST, bool))
        for k in range(2, LONGEST):
            going = going & follows[at + k - 1]
            w.append(np.where(going, padded[at + k], 0))
        keys = [lang[at], *w]
        order = np.lexsort(keys[::-1])
        new = np.any([np.append(True, k[order][1:] != k[order][:-1]) for k in keys], axis=0)
        first, c = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
        cols = [words.take(pa.array(x[first] - 1, mask=x[first] == 0)) for x in w]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at][first])), *cols, pa.array(c)], ["lang", *WORDS, "c"])


def _scan(batches, least: int):
    """Rows (words, c) of every phrase of a sorted stream that is frequent, or that the streams before or after may go on with."""
    last, open_runs = None, {}

    def done(found):
        langs, rows, counts = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.utf8()), pa.array(rows, pa.list_(pa.utf8())), pa.array(counts, pa.int64())], ["lang", "words", "c"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [pc.fill_null(b.column(k), "") for k in range(LONGEST + 1)]
        c, found = b.column(LONGEST + 1).to_numpy(), []
        new = np.zeros(b.num_rows, bool)
        for k, col in enumerate(cols):
            before = pa.array([last[k] if last else None], pa.utf8())
            prev = pa.concat_arrays([before, col.slice(0, b.num_rows - 1)])
            new = new | pc.fill_null(pc.not_equal(col, prev), True).to_numpy(zero_copy_only=False)
            if k < 2:
                continue
            starts = np.flatnonzero(new)
            if k in open_runs:
                row, n, edge = open_runs[k]
                n += int(c[: starts[0] if len(starts) else None].sum())
                open_runs[k] = row, n, edge
                if len(starts) and row and (edge or n >= least):
                    found.append((row[0], row[1:], n))
            if len(starts):
                sums, edge = np.add.reduceat(c, starts), k not in open_runs
                row = [x[int(starts[-1])].as_py() for x in cols[: k + 1]]
                open_runs[k] = row if row[-1] else None, int(sums[-1]), edge and len(starts) == 1
                whole = pc.not_equal(col.take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
                # The first run of a stream may have begun in the one before.
                keep = np.flatnonzero(whole[:-1] & ((sums[:-1] >= least) | (edge & (np.arange(len(sums) - 1) == 0))))
                at = pa.array(starts[keep])
                taken = [x.take(at).to_pylist() for x in cols[: k + 1]]
                found += zip(taken[0], map(list, zip(*taken[1:])), sums[keep].tolist())
        last = [x[b.num_rows - 1].as_py() for x in cols]
        yield done(found)
    yield done([(row[0], row[1:], n) for row, n, _ in open_runs.values() if row])


def frequent(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, c) of phrases of one to LONGEST words with a count of ``least`` or more, and (lang, n)."""
    base = counted(docs, least, text_col, lang_col)
    pairs = pair_map(base.where("pair is not null"))
    rows = _texts(docs, text_col, lang_col).mapInArrow(lambda it: _places(it, pairs), f"lang string, {', '.join(f'{w} string' for w in WORDS)}, c long")
    rows = store(rows, "places").repartitionByRange("lang", *WORDS).sortWithinPartitions("lang", *WORDS)
    found = rows.mapInArrow(lambda it: _scan(it, least), "lang string, words array<string>, c long")
    found = found.groupBy("lang", "words").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    words = base.where("word is not null").select("lang", F.array("word").alias("words"), "c")
    return store(words.union(found), "frequent"), base.where("word is null and pair is null").select("lang", F.col("c").alias("n"))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases by score.

    a, l and r are the counts of the phrase and of its two parts where it is
    cut so that the score, floor(1000 a n / (l r)), is least. Phrases that a
    longer one with the same count contains are left out. Scores are computed
    with 38 digits.
    """
    phrases, every = frequent(docs, least, text_col, lang_col)
    long = phrases.where(F.size("words") > 1)
    # The two orders of the streams; each side of a join is stored, so that a hot first or last word can be split.
    forward = lambda name: phrases.select("lang", F.col("words").alias("key"), F.col("c").alias(name))
    backward = lambda name: phrases.select("lang", F.reverse("words").alias("key"), F.col("c").alias(name))
    cuts = long.select("lang", "words", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    heads = cuts.withColumn("key", F.slice("words", F.lit(1), F.col("k"))).join(forward("l").hint("merge"), ["lang", "key"]).drop("key")
    tails = heads.withColumn("key", F.reverse(F.expr("slice(words, k + 1, size(words) - k)"))).join(backward("r").hint("merge"), ["lang", "key"]).drop("key")
    # What a phrase one word longer has as its count: those to the right in prefix order, those to the left in suffix order.
    right = long.select("lang", F.expr("slice(words, 1, size(words) - 1)").alias("words"), "c").where(F.size("words") > 1)
    left = long.select("lang", F.expr("slice(words, 2, size(words) - 1)").alias("words"), "c").where(F.size("words") > 1)
    longer = store(right.union(left).groupBy("lang", "words").agg(F.max("c").alias("longer")), "longer")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    scored = tails.join(broadcast_small(every, 64), "lang").withColumn("up", 1000 * whole("a") * whole("n")).withColumn("down", whole("l") * whole("r"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.join(longer.hint("merge"), ["lang", "words"], "left").where("longer is null or 100 * longer < 100 * a")
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
every AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY 1),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, m, ws[i:i + m - 1] AS p FROM places, range(1, 6) AS t(m) WHERE i + m - 1 <= len(ws)),
freq AS (SELECT lang, m, p, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT x.lang, x.p, x.m, x.c AS a, h.c AS l, t.c AS r, n, h.m AS k, ((1000::HUGEINT * x.c * n) // (h.c::HUGEINT * t.c))::BIGINT AS score
  FROM freq x JOIN freq h ON h.lang = x.lang AND h.m < x.m AND h.p = x.p[1:h.m]
  JOIN freq t ON t.lang = x.lang AND t.m = x.m - h.m AND t.p = x.p[h.m + 1:x.m] JOIN every e ON e.lang = x.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM freq g WHERE g.lang = b.lang AND g.m = b.m + 1 AND 100 * g.c >= 100 * b.a AND (g.p[1:b.m] = b.p OR g.p[2:b.m + 1] = b.p))),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
