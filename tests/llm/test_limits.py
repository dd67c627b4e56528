"""What operators do with null keys, odd weights, rare sources and very many matches."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lines, mixing, packing, pii, simhash, toolcalls


def test_turns_without_conversation_or_turn_stay(spark):
    """Every turn that asks is a call, linked or not; equal turns are duplicates, and order is by role and text."""
    rows = [(1, 0, "user", "a question long enough"), (1, 1, "assistant", "answer"), (None, 0, "user", "whose?"), (1, None, "system", "when?"), (None, None, "user", None), (None, 1, "assistant", "to whom?"), (1, None, "assistant", "late"), (2, 0, None, "no role"), (3, 4, "user", "x"), (3, 4, "user", "a"), (3, 5, "assistant", "both")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(((r["conv_id"], r["turn"], r["status"], r["call_id"]) for r in toolcalls.link(*toolcalls.turns_as_calls(df), toolcalls.TURN_TOOLS).collect()), key=str)
    assert got == sorted([("1", 0, "linked", "call-1-0"), (None, 0, "unlinked", None), ("1", None, "unlinked", None), (None, None, "unlinked", None), ("3", 4, "linked", "call-3-4"), ("3", 4, "duplicate", "call-3-4")], key=str)


@pytest.mark.parametrize("late", [0.0, -1.0, math.nan])
def test_documents_without_weight_come_last(spark, late):
    """A source of 200 equal documents, half of them without weight, of which half are taken: those with weight."""
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(200)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, late if i % 2 else 1.0) for i in range(200)], "id long, weight double")
    got = mixing.mix(docs, quality, share=0.5).where("taken > 0").collect()
    assert len(got) == 100 and all(r["id"] % 2 == 0 for r in got)
    every = mixing.mix(docs, quality.withColumn("weight", F.lit(late)), share=0.5).where("taken > 0").collect()
    assert len(every) == 100 and len({r["id"] % 2 for r in every}) == 2


def test_odd_weights(spark):
    """Null counts as 1, infinity comes first, the smallest numbers there are do no harm."""
    docs = spark.createDataFrame([(i, "w " * 5, "s") for i in range(40)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(0, math.inf), (1, None), (2, 5e-324), (3, 1e308)], "id long, weight double")
    got = {r["id"]: r["taken"] for r in mixing.mix(docs, quality, share=0.5).collect()}
    assert len(got) == 40 and sum(got.values()) == 100 and got[0] == got[3] == 5 and got[2] == 0


def plain_pieces(plan, q, first, n):
    """The rounds one by one."""
    out = []
    for w in range(plan.rounds):
        a, b = (int(plan.served(np.array(x), q)) for x in (w, w + 1))
        lo, hi = max(a, first), min(b, first + n)
        if lo < hi:
            pos = sum(int(plan.served(np.array(w + 1), k)) for k in range(q)) + sum(int(plan.served(np.array(w), k)) for k in range(q, len(plan.totals)))
            out.append((lo - first, pos + lo - a, hi - lo))
    return out


def test_rounds_of_rare_and_common_sources():
    """Pieces as from a walk over all rounds, for sources that are served in every round or hardly ever."""
    g = np.random.default_rng(8)
    for totals in ([20, 50_000], [1, 1, 1, 90_000], [40_000, 333, 17, 5000], [4096, 4096], [7], [100, 60_001, 3], g.integers(1, 9000, 30).tolist()):
        plan = packing.Schedule(sorted(totals, reverse=True), 512, 16)
        for q, total in enumerate(sorted(totals, reverse=True)):
            at = 0
            while at < total:
                n = min(int(g.integers(1, 700)), total - at)
                assert list(zip(*(x.tolist() for x in plan.pieces(q, at, n)))) == plain_pieces(plan, q, at, n)
                at += max(n, total // 5)


def test_a_rare_source_takes_no_memory():
    """Twenty tokens beside 10^12: found at once, whatever lies between two of their turns."""
    import tracemalloc

    plan = packing.Schedule([10**12, 20], 4096, 16)
    tracemalloc.start()
    began = time.time()
    start, pos, n = plan.pieces(1, 0, 20)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20 and time.time() - began < 1
    tracemalloc.stop()
    assert n.sum() == 20 and start.tolist() == np.concatenate(([0], np.cumsum(n)[:-1])).tolist() and 0 <= pos.min() and (pos + n).max() <= 10**12 + 20


def test_very_many_matches_in_one_text(spark):
    """Spans of thousands of addresses in one text, with their surroundings, in time that grows with their number."""
    def text(n):
        return "é " + " ".join(f"user{i}@mail.org,call 212-555-{i % 9000 + 1000}" for i in range(n)) + " end"

    took = {}
    for n in (300, 3000):
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        began = time.time()
        row = pii.find(df).first()
        took[n] = time.time() - began
        spans = [text(n)[x["s"] : x["e"]] for x in row["base"]]
        assert spans == [f"user{i}@mail.org" for i in range(n)]
        assert len(row["added"]) == n
    found = pii.candidates(df).first()["found"]
    for c in found:
        t = text(3000)
        assert c["m"] == t[c["s"] : c["e"]] and c["before"] == t[max(c["s"] - 24, 0) : c["s"]].lower() and c["after"] == t[c["e"] : c["e"] + 1]


def shingle_sets(texts, n=5):
    ws = [t.split() for t in texts]
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in ws]


def plain_groups(texts, bound=0.8):
    """(smallest place reachable, number of linked pairs, pairs) over all pairs."""
    sets, root, found = shingle_sets(texts), list(range(len(texts))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            either = len(sets[i] | sets[j])
            if (both >= bound * either) if either else True:
                found.append((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], found


def copies(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("vocabulary", [2, 3, 6])
def test_texts_of_few_words_lose_no_link(spark, vocabulary):
    """Tables and logs: many texts that share their words, pairs of words and whole words of prints."""
    g = random.Random(vocabulary)
    bases = [[str(g.randrange(vocabulary)) for _ in range(60)] for _ in range(60)]
    texts = []
    for b in bases:
        near = list(b)
        near[g.randrange(60)] = str(g.randrange(vocabulary))
        texts += [" ".join(b), " ".join(near)]
    groups, found = plain_groups(texts)
    got = copies(spark, texts)
    # Those at the bound may be missed by chance; nothing is missed because words are shared.
    assert len(found) > 20 and sum(got[i] == got[j] for i, j in found) >= 0.95 * len(found)
    assert all(groups[got[i]] == groups[i] for i in range(len(texts)))


@pytest.mark.parametrize("low, high", [(0.8, 0.82), (0.85, 0.87), (0.9, 0.95)])
def test_replaced_endings(spark, low, high):
    """A new ending changes as many short shingles as long ones, in one place: 0.9 of such pairs are found at the bound."""
    g = random.Random(int(low * 100))
    texts, pairs = [], []
    while len(pairs) < 150:
        n = g.randrange(60, 400)
        base = [f"w{g.randrange(5000)}" for _ in range(n)]
        for cut in range(n, 0, -1):
            other = base[:cut] + [f"z{g.randrange(10**9)}" for _ in range(n - cut)]
            a, b = shingle_sets([" ".join(base), " ".join(other)])
            if len(a & b) / len(a | b) < high:
                break
        if len(a & b) / len(a | b) >= low:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(base), " ".join(other)]
    got = copies(spark, texts)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(got[i] in (i, i - i % 2) for i in range(len(texts)))


def test_hub_and_hot_key(spark):
    """One large group around a text, with members that are alike only through it, next to groups that share its keys."""
    g = random.Random(9)
    base = [f"v{g.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(300):
        other = list(base)
        for i in g.sample(range(200), g.choice([1, 2, 4, 5])):
            other[i] = f"n{g.randrange(10**9)}"
        texts.append(" ".join(other))
    groups, _ = plain_groups(texts)
    assert copies(spark, texts) == groups


def test_pairs_of_a_hot_key_can_be_split(spark):
    """Every join of an index with itself or with its keys has plain exchanges on both sides."""
    labelled = spark.range(1000).select(F.xxhash64("id").alias("fp"), (F.col("id") % 5).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.bucket_pairs(labelled, 4, 4)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Window" not in physical and physical.count("SortMergeJoin") >= 2
    lines = [x.strip(" :+-") for x in physical.splitlines()]
    for i, x in enumerate(lines):
        if x.startswith("SortMergeJoin"):
            assert lines[i + 1].startswith("Sort") and lines[i + 2].startswith(("Exchange hashpartitioning", "ReusedExchange"))


def test_odd_sketches_rule_out_no_pair_that_is_alike(spark):
    """Sets of all levels, from empty to some thousands, at the bound and far below it; whole sets within the exact bound."""
    g = np.random.default_rng(5)
    rows, true = [], []
    for n in (0, 1, 4, 20, 200, 409, 410, 511, 512, 513, 640, 900, 1024, 1025, 1200, 5000):
        for similar in (1.0, 0.8, 0.8, 0.5, 0.1):
            a = g.choice(2**32 - 1, n, replace=False).astype(np.uint32)
            gone = int(n * (1 - similar) / (1 + similar))
            b = np.unique(np.concatenate([a[gone:], g.integers(0, 2**32, gone).astype(np.uint32)]))
            if similar == 0.8 and len(true) % 2:
                b = np.unique(a[int(np.floor(n * 0.2)) :])  # a part of the other: the counts differ the most
            s, t = simhash.odd_sketch(a, 0.8), simhash.odd_sketch(b, 0.8)
            both = len(np.intersect1d(a, b))
            true.append((both / (len(a) + len(b) - both)) if n else 1.0)
            if simhash.sketch_level(n) == simhash.sketch_level(len(b)) == 0:
                assert np.bitwise_count((s[:8] ^ t[:8]).view(np.uint64)).sum() <= len(a) + len(b) - 2 * both
            rows.append((len(rows), len(a), simhash.sketch_level(len(a)), s.tolist(), len(b), simhash.sketch_level(len(b)), t.tolist()))
    schema = "i int, n_u int, level_u int, sketch_u array<long>, n_v int, level_v int, sketch_v array<long>"
    got = {r["i"]: r["maybe"] for r in spark.createDataFrame(rows, schema).select("i", simhash.may_be_alike(0.8).alias("maybe")).collect()}
    assert all(got[i] for i, x in enumerate(true) if x >= 0.8)
    assert not any(got[i] for i, x in enumerate(true) if x < 0.4)


def test_copies_alike_to_their_text_only_make_few_pairs(spark):
    """Copies between 0.6 and 0.75 alike to each other: their pairs, which grow with the square, go within the join."""
    g = random.Random(4)
    base = [f"v{g.randrange(3000)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        other = list(base)
        for i in g.sample(range(200), 8):
            other[i] = f"n{g.randrange(10**9)}"
        texts.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.described(df, "doc_id", "text", 5, 0.8).withColumn("label", F.col("node")).withColumn("fp", F.get("prints", F.lit(0))).cache()
    plain = simhash.bucket_pairs(nodes, simhash.KEYED, simhash.WORD_BITS, "node").select(F.least("u", "v"), F.greatest("u", "v")).distinct().count()
    fewer = simhash.bucket_pairs(nodes, simhash.KEYED, simhash.WORD_BITS, "node", bound=0.8).select(F.least("u", "v"), F.greatest("u", "v")).distinct().count()
    assert plain > 1000 and fewer < plain / 20
    groups, _ = plain_groups(texts)
    assert copies(spark, texts) == groups


def test_lines_meet_their_texts_in_one_way_at_any_size(spark):
    """Few lines to remove don't turn the texts' one shuffle into a broadcast, so that disk grows as the input does."""
    df = spark.createDataFrame([(i, "a\nb\nc") for i in range(9)], "doc_id long, text string")
    out = lines.deduplicate_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(i, 3 if i else 0) for i in range(9)]


def test_wide_columns_join_a_node_once(spark):
    """Sketches meet a node, not each of its keys in mixed buckets, and the keys meet their buckets in one plan at any size; the pairs are all of those that may be alike."""
    g = random.Random(8)
    base = [f"v{g.randrange(900)}" for _ in range(100)]
    texts = [" ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) for i, k in enumerate(g.choices(range(100), k=12))] + ["other words " * 9, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.store(simhash.described(df, "doc_id", "text", 5, 0.8).withColumn("label", F.col("node")).withColumn("fp", F.get("prints", F.lit(0))), "nodes")
    pairs = simhash.bucket_pairs(nodes, simhash.KEYED, simhash.WORD_BITS, "node", bound=0.8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "collect_list(struct(key" in plan and not any("Broadcast" in x for x in joins if "[key#" in x)
    own = lambda x: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("n", "level", "sketch")], F.col("node").alias(x), F.col("fp").alias(f"f{x}"))
    # Five bits of a word that differ leave one segment with one at most, which a key finds.
    want = own("u").crossJoin(own("v")).where((F.col("u") < F.col("v")) & simhash._near("fu", "fv", 5) & simhash.may_be_alike(0.8)).select("u", "v")
    got = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    assert want.count() > 5 and want.subtract(got).count() == 0


def test_texts_with_shingles_of_their_own_are_not_indexed(spark, monkeypatch):
    """A text over a fifth of whose shingles no other has goes before the index, copies and all; one at the bound of 0.8 stays and is linked."""
    g = random.Random(12)
    shared = [f"s{i}" for i in range(30)]
    texts = [" ".join(shared + [f"x{g.randrange(10**9)}" for _ in range(40)]) for _ in range(60)]
    texts += texts[:5]  # copies are one set, which is no other's
    at = [f"b{i}" for i in range(84)]
    first = len(texts)
    texts += [" ".join(at), " ".join(at[:68]), " ".join(at[:66] + ["y"])]  # 80 shingles, 64 of them, 62 of them and one of its own
    texts += ["", "a b", "a b c"]
    tables, plain = {}, simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, name: tables.setdefault(name, []).append(plain(df, name)) or tables[name][-1])
    got = copies(spark, texts)
    groups, found = plain_groups(texts)
    assert got == groups and got[first + 1] == first and (first, first + 1) in found and (first, first + 2) not in found
    # The three, and the blank text, which has no shingle.
    assert tables["nodes"][0].count() <= 4
    left = [t.count() for t in tables["left"]]
    assert left == sorted(left, reverse=True) and left[0] == 66 and left[-1] <= 4


def test_a_pair_is_asked_for_from_one_side(spark):
    """Pairs between groups come from the smaller one only, and are those of brute force at one differing bit a segment or none."""
    g = random.Random(13)
    base = [f"v{g.randrange(900)}" for _ in range(100)]
    texts = [" ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) for i, k in enumerate(g.choices(range(100), k=24))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.described(df, "doc_id", "text", 5, 0.8).withColumn("label", F.when(F.col("id") < 14, 1).otherwise(F.col("id")).cast("long")).withColumn("fp", F.get("prints", F.lit(0)))
    nodes = simhash.store(nodes, "nodes")
    got = {(r["u"], r["v"]) for r in simhash.bucket_pairs(nodes, simhash.KEYED, simhash.WORD_BITS, "node", bound=0.8).collect()}
    rows = {r["node"]: (r["label"], r["fp"]) for r in nodes.collect()}
    assert all(rows[u][0] != 1 for u, _ in got) and not any((v, u) in got for u, v in got)

    def meet(x, y):
        bits = (x ^ y) % (1 << 64)
        return bits.bit_count() <= simhash.WORD_BITS and any(((bits >> at) & ((1 << n) - 1)).bit_count() <= 1 for at, n in simhash.segments(simhash.KEYED))

    want = {frozenset((a, b)) for a in rows for b in rows if rows[a][0] < rows[b][0] and meet(rows[a][1], rows[b][1])}
    assert len(want) > 20 and {frozenset(x) for x in got} == want
