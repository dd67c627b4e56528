"""Operators against brute force, and their results in edge cases."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from oracle import check
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import exact, graph, lines, minhash, mixing, packing, pii, queries, repeats, simhash, toolcalls, toxicity
from orrery.llm.common import split_words, text_slices

WS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, further columns with clashing names."""
    g = random.Random(5)
    long = " ".join(g.choice(["alpha", "beta", "gamma", "delta", "epsilon", "x1", "éà", "日本"]) + str(g.randrange(300)) for _ in range(6000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("w30", "zz"), "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n ", "en", "b", 4),
        (7, long, "en", "b", len(long)), (8, long + " end", "en", "c", 1), (9, "one", "en", "a", 3), (10, "one two three", "en", "a", 3), (11, "A b\nc d\ne f\ng h", "en", "a", 3), (12, "x\nc d\ne f\ng h\n\ntail", "en", "a", 3),
        (13, "mail a.b@c.org or +1 (212) 555-1234, 10.0.0.1, 4111 1111 1111 1111", "en", "a", 3), (13, "mail a.b@c.org or +1 (212) 555-1234, 10.0.0.1, 4111 1111 1111 1111", "en", "a", 3), (None, "no id at all", "en", "a", 3), (14, "　wide space İ <|endoftext|> 🙂", "en", "ü", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the operators use inside.
    return df.withColumns({c: F.lit("clash") for c in ("id", "fp", "n", "size", "key", "part", "row", "target", "digest", "__id", "label", "root", "queue", "first", "gone", "col", "line_id", "mix_id")})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd_docs(spark).write.parquet(p)
    return spark.read.parquet(p)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


# -- 1 ------------------------------------------------------------------

def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash(spark, small):
    rows = sorted(pairs(small))
    got = {r["id"]: r for r in minhash.compare_edited(small).collect()}
    errors = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))), abs(r["near_next"] - jaccard(shingles(t), shingles(nxt)))]
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    by_text = defaultdict(set)
    for d, t in rows:
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_minhash_odd(docs):
    got = minhash.compare_edited(docs).collect()
    assert len(got) == docs.count()
    one = {r["id"]: r for r in got}
    assert one[1]["fingerprint"] == one[2]["fingerprint"] and one[1]["near_next"] == 1.0
    assert set(one[4]["fingerprint"]) == {"0"} and one[4]["near_next"] == 1.0 and one[6]["near_next"] == 0.0
    assert one[None]["near_next"] is None
    assert minhash.compare_edited(docs.limit(0)).count() == 0


# -- 2 ------------------------------------------------------------------

def test_toolcalls(spark):
    calls = spark.createDataFrame(
        [("c", 1, "a", "t", '{"y": 1, "x": "é"}', ["b"]), ("c", 2, "b", "t", '{"x": 2}', None), ("c", 3, "b", "t", "{}", []), ("d", 1, "p", "t", "nope", ["q"]), ("d", 2, "q", "u", "{}", ["p"]), ("d", 3, "r", "t", '{"x":"s"}', ["zz"]), ("e", None, None, "t", None, None), (None, 1, "n", "t", "{}", None)],
        "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("c", 5, "a", "late"), ("c", 4, "a", "r\n"), ("c", 4, "zz", "orphan")], "conv_id string, turn long, call_id string, content string")
    schemas = {"t": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string"}}}}
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in toolcalls.link(calls, results, schemas).collect()}
    assert len(got) == 8
    a, b = got["c", "a", 1], got["c", "b", 2]
    assert (b["position"], a["position"]) == (0, 1)
    assert a["canonical"] == '{"arguments":{"x":"é","y":1},"id":"a","name":"t","result":"r\\n"}' and a["valid"] and a["status"] == "linked"
    assert b["problems"] == "$.x: not string" and b["status"] == "pending"
    assert got["c", "b", 3]["status"] == "duplicate" and got["d", "p", 1]["status"] == got["d", "q", 2]["status"] == "cyclic"
    assert got["d", "r", 3]["position"] == 0 and got["d", "p", 1]["problems"] == "$: not a JSON object"
    assert got["e", None, None]["status"] == got[None, "n", 1]["status"] == "unlinked"
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_toolcalls_survive_odd_json_and_schemas(spark):
    schemas = {"t": {"type": "object", "properties": {"a": {"type": ["string", "null"], "pattern": "^x"}, "n": {"type": "integer"}, "c": {"const": 1}, "o": {"anyOf": [{"type": "array", "items": {"type": "boolean"}}, {"enum": [True]}]}}}}
    given = ['{"a": "\\ud800"}', '{"a": null, "n": 1.0, "c": 1, "o": [true]}', '{"a": "y", "n": 1.5, "c": true, "o": [1]}', '{"n": 1e999}', '{"n": NaN}', "[" * 5000, "null", "", '{"a": "' + "x" * 300_000 + '"}', '{"\\udc00": {"b": 1}}']
    calls = spark.createDataFrame([("c", i, f"k{i}", "t", a, None) for i, a in enumerate(given)], "conv_id string, turn long, call_id string, name string, arguments string, depends_on array<string>")
    calls = calls.unionByName(calls.limit(3))
    results = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    rows = toolcalls.link(calls, results, schemas).collect()
    got = {r["turn"]: r for r in rows if r["status"] == "pending"}
    assert len(rows) == 13 and len(got) == 10 and sum(r["status"] == "duplicate" for r in rows) == 3
    assert [got[i]["valid"] for i in range(10)] == [False, True, False, False, False, False, False, False, True, True]
    assert got[0]["canonical"].startswith('{"arguments":{"a":"\\ud800"}') and got[3]["canonical"].startswith('{"arguments":null')
    assert got[2]["problems"] == "$.a: not of the pattern; $.c: not one of the values; $.n: not integer; $.o: none of the forms"
    with pytest.raises(ValueError, match="patternProperties"):
        toolcalls.link(calls, results, {"t": {"properties": {"x": {"patternProperties": {}}}}})


@pytest.mark.parametrize("most", [3, 100_000])
def test_order_is_the_longest_chain(spark, most):
    g = random.Random(7)
    rows = []
    for conv in range(12):
        n = g.randrange(1, 9)
        rows += [(conv, g.randrange(20), f"k{i}", [f"k{g.randrange(n + 1)}" for _ in range(g.randrange(3))]) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, depends_on array<string>")
    want = {}
    for conv in range(12):
        own = {k: (t, d) for c, t, k, d in rows if c == conv}

        def depth(k, seen=()):
            if k in seen:
                return None
            below = [depth(d, (*seen, k)) for d in own[k][1] if d in own]
            return None if None in below else max((x + 1 for x in below), default=0)

        plain = all(own[d][0] < t for t, ds in own.values() for d in ds if d in own)
        want |= {(conv, k): 0 if plain else depth(k) for k in own}
    assert {(r["conv_id"], r["call_id"]): r["round"] for r in toolcalls.order(df, most).collect()} == want


def test_long_chains_are_ordered_in_one_pass(spark):
    n = 1000
    df = spark.createDataFrame([(1, -i, f"k{i}", [f"k{i - 1}"]) for i in range(n)], "conv_id long, turn long, call_id string, depends_on array<string>")
    assert {r["call_id"]: r["round"] for r in toolcalls.order(df).collect()} == {f"k{i}": i for i in range(n)}


# -- 3 ------------------------------------------------------------------

def plain_simhash(t, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("source", ["docs", "small"])
def test_simhash(request, source):
    df = request.getfixturevalue(source)
    rows = pairs(df)
    fps = [plain_simhash(t) for _, t in rows]
    want = sorted((d or -1, f, c or -1) for (d, _), f, c in zip(rows, fps, plain_components([d for d, _ in rows], fps)))
    got = sorted((r["id"] or -1, r["fp"] % (1 << 64), r["component_id"] or -1) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [2, 4, 7])
def test_link_finds_every_pair(spark, distance):
    g = random.Random(9)
    seeds = [g.getrandbits(64) for _ in range(12)]
    fps = list({s ^ sum(1 << b for b in g.sample(range(64), g.randrange(7))) for s in seeds for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["node"]: r["root"] for r in simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()}
    groups = lambda roots: {frozenset(i for i in range(len(fps)) if roots[i] == r) for r in set(roots)}
    assert groups([got[f] for f in signed]) == groups(plain_components(signed, fps, distance))


def test_components(spark):
    g = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + g.randrange(40), 100 + g.randrange(40)) for _ in range(30)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)


# -- 4 ------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        left = sum(w[s] for s in names if s not in full)
        t = {s: 2 * sizes[s] if s in full else rest * w[s] / left for s in names}
        over = {s for s in names if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("source", ["docs", "small"])
def test_mixing(request, source):
    df = request.getfixturevalue(source)
    once, again = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert once == again and len(once) == df.count()
    sizes, taken, most, goal = Counter(), Counter(), Counter(), {}
    for _, s, size, whole, target, took in once:
        sizes[s] += size
        taken[s] += took
        most[s] = max(most[s], size)
        goal[s] = target
        assert took in (0, size, 2 * size)
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(want[s] - goal[s]) < 1e-6
        assert abs(taken[s] - goal[s]) <= most[s] / 2 + 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_better_documents_are_taken_more(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    w = df.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(df, w).where("source = 'c'").groupBy((F.col("id") % 2).alias("odd")).agg(F.avg(F.col("taken") / F.col("size")).alias("share")).collect()
    share = {r["odd"]: r["share"] for r in got}
    assert share[0] > 1.3 * share[1]


# -- 5 ------------------------------------------------------------------

@pytest.mark.parametrize("source", ["docs", "small"])
def test_repeats(request, source):
    df = request.getfixturevalue(source)
    rows = pairs(df)
    far = 1 << 62
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, far), far if d is None else d)
    want = []
    for d, t in rows:
        w = words(t)
        out = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (far if d is None else d):
                out[i : i + 13] = [True] * 13
        want.append((d or -1, len(w), sum(out), " ".join(x for x, o in zip(w, out) if not o)))
    got = [(r["id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 400, 1 << 20])
def test_repeats_are_settled_the_same_in_slices_of_any_size(monkeypatch, most):
    """The steps of the operator in one process, over slices so small that copies meet in one or in several."""
    monkeypatch.setattr(repeats, "text_slices", lambda texts: text_slices(texts, most))
    g = random.Random(12)
    shared = [[f"s{k}{i}" for i in range(g.randrange(13, 40))] for k in range(6)]
    texts = []
    for _ in range(120):
        own = [f"o{g.randrange(10**6)}" for _ in range(g.randrange(0, 30))]
        for part in g.sample(shared, g.randrange(3)):
            at = g.randrange(len(own) + 1)
            own[at:at] = part
        texts.append(" ".join(own))
    ids = g.sample(range(1000), len(texts))
    parts = 5

    def exchange(rows):
        by = defaultdict(list)
        for b in rows:
            for r in b.to_pylist():
                by[r["part"]].append(r)
        for rs in by.values():
            rs.sort(key=lambda r: r["kind"])
            yield repeats._batches(tuple(r.values()) for r in rs)

    def batch(extra=None):
        cols = [pa.array(ids, pa.int64()), pa.array(texts), pa.array([0] * len(ids), pa.int64())]
        names = ["id", "text", "text_key"]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(extra, pa.list_(pa.int32()))] if extra else []), names + (["places"] if extra else []))

    def gathered(step, rows):
        out = defaultdict(set)
        for batches in exchange(rows):
            for b in step(batches):
                for r in b.to_pylist():
                    out[r["id"]].add(r["place"])
        return out

    hits = gathered(repeats._match, repeats._runs([batch()], parts, 7))
    starts = gathered(repeats._later, repeats._around([batch([sorted(hits[i]) for i in ids])], parts, 7))
    first = {}
    for i, t in zip(ids, texts):
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = {i: {k for k in range(len(words(t)) - 12) if first[tuple(words(t)[k : k + 13])] < i} for i, t in zip(ids, texts)}
    assert {i: s for i, s in starts.items() if s} == {i: s for i, s in want.items() if s} and sum(map(len, want.values())) > 300


# -- 6 ------------------------------------------------------------------

def test_fuse_filter():
    g = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 50_000):
        keys, other = g.integers(0, 1 << 60, n, dtype=np.uint64), g.integers(1 << 61, 1 << 62, 20_000, dtype=np.uint64)
        f = exact.FuseFilter.build(keys)
        assert f.holds(keys).all()
        assert f.holds(other).mean() < 0.01
    assert len(f.cells) < 1.35 * n


def test_exact_odd(docs):
    old, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    got = sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.deduplicate(new, old).collect()), key=str)
    texts = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in pairs(docs)]
    size, keep = Counter(t for _, t in texts), {}
    for d, t in texts:
        keep[t] = min((x for x in (d, keep.get(t)) if x is not None), default=None)
    assert got == sorted(((d, keep[t], size[t], d == keep[t]) for d, t in texts), key=str)
    assert exact.deduplicate(docs.limit(0), docs.limit(0)).count() == 0
    assert exact.deduplicate(docs, docs.limit(0)).count() == docs.count()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_exact_shuffles_only_texts_that_are_met(spark, most, monkeypatch):
    """Few digests to look for are broadcast whatever Spark's own limit is, many meet texts that are reduced; both find the same."""
    monkeypatch.setattr(exact, "MAX_BROADCAST", most, raising=False)
    old = spark.createDataFrame([(i, f"old {i % 50}") for i in range(200)], "doc_id long, text string")
    new = spark.createDataFrame([(i + 200, f"old {i % 70}") for i in range(140)], "doc_id long, text string")
    found = exact.store(exact.digests(old.where("doc_id < 50")).select("digest"), "found")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = exact.same_bytes(old, new, found)
        plan = same._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 0)
        assert same.count() == same.distinct().count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact.deduplicate(new, old).collect()}
    assert got == {i: (k, 6) if k < 50 else (k + 200, 2) for i in range(340) for k in [i % 50 if i < 200 else (i - 200) % 70]}


# -- 7 ------------------------------------------------------------------

def test_gradients():
    """The network's gradients against differences."""
    p = {k: v.astype(np.float64) for k, v in toxicity.init(["a", "b"], 3).items()}
    g = np.random.default_rng(0)
    proj, at = g.standard_normal((7, 6 * toxicity.HIDDEN)), g.integers(0, 7, (5, 4))
    mask = np.ones((5, 4))
    mask[3:, 1] = 0
    d = g.standard_normal(4)
    kept: list = []
    toxicity.forward(p, proj, at, mask, kept)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    d_proj = toxicity.backward(p, at, kept, d, 7, grad)
    for a, b, i in [(proj, d_proj, (2, 3)), (proj, d_proj, (4, 40)), *((p[k], grad[k], (1, 2)) for k in ("u0", "u1", "wa")), (p["va"], grad["va"], (3,)), (p["out"], grad["out"], (5,))]:
        keep, eps = a[i], 1e-3
        a[i] = keep + eps
        up = toxicity.forward(p, proj, at, mask) @ d
        a[i] = keep - eps
        down = toxicity.forward(p, proj, at, mask) @ d
        a[i] = keep
        assert abs((up - down) / (2 * eps) - b[i]) < 1e-3 * max(1, abs(b[i]))


def test_toxicity(spark, docs):
    g = random.Random(1)
    vocab = ["".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    make = lambda bad: " ".join(["zorky" if bad and i in (20, 90) else g.choice(vocab) for i in range(120)])
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["id"]: r for r in toxicity.classify(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [(d, y) for d, _, y in rows if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows)
    assert np.mean([got[d]["predicted"] == y for d, y in held]) > 0.95
    out = toxicity.classify(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0 for r in toxicity.classify(docs, df.select("doc_id", "toxic").limit(0)).collect())


def plain_score(p, vocab, text):
    """A text's score word by word and step by step, in plain Python."""
    h_dim, mix, factor = toxicity.HIDDEN, int(toxicity.SPREAD), int(toxicity.RUN)
    sig = lambda x: 1 / (1 + np.exp(-np.float64(x)))

    def bucket(h):
        return (h * mix % (1 << 64)) >> (64 - toxicity.BUCKETS.bit_length() + 1)

    def run(chars):
        h = 0
        for c in chars:
            h = (h * factor + ord(c)) % (1 << 64)
        return h

    def vector(word):
        w = word.lower().strip(toxicity.MARKS)
        b = f"<{w}>"
        grams = [bucket((run(b[i : i + n]) + n) % (1 << 64)) for n in (3, 5) for i in range(len(b) - n + 1)] + [bucket(run(b + "\0"))]
        x = np.concatenate((p["word"][vocab.get(w, 0)], np.mean([p["char"][g] for g in grams], axis=0)))
        return x @ p["wx"] + p["b"]

    def states(xs, u):
        h, out = np.zeros(h_dim), []
        for x in xs:
            q = h @ u
            r, z = sig(x[:h_dim] + q[:h_dim]), sig(x[h_dim : 2 * h_dim] + q[h_dim : 2 * h_dim])
            h = z * h + (1 - z) * np.tanh(x[2 * h_dim :] + r * q[2 * h_dim :])
            out.append(h)
        return out

    ws, best = words(text), -np.inf
    for lo in toxicity.window_starts(len(ws)):
        xs = [vector(w) for w in ws[lo : lo + toxicity.STEPS]]
        ahead, back = states([x[: 3 * h_dim] for x in xs], p["u0"]), states([x[3 * h_dim :] for x in xs][::-1], p["u1"])[::-1]
        s = [np.concatenate(x) for x in zip(ahead, back)]
        e = [np.exp(np.tanh(x @ p["wa"]) @ p["va"]) for x in s]
        pooled = sum(x * y for x, y in zip(s, e)) / sum(e) if s else np.zeros(2 * h_dim)
        best = max(best, pooled @ p["out"] + p["bias"][0])
    return sig(best)


def test_scores_are_those_of_a_plain_forward_pass(small):
    texts = [t for _, t in pairs(small)[:40]] + ["", " \n", "a", "É!! (Straße) x²", "one two " * 40]
    vocab = {w: i + 1 for i, w in enumerate(sorted({w.lower().strip(toxicity.MARKS) for w in words(texts[0])}))}
    p = toxicity.init(sorted(vocab), 5)
    p["bias"][:] = 0
    got = toxicity.scores(p, vocab, pa.array(texts))
    assert max(abs(a - plain_score(p, vocab, t)) for a, t in zip(got, texts)) < 1e-4
    assert len(toxicity.scores(p, vocab, pa.array([], pa.string()))) == 0 and np.std(got) > 0.01


def test_windows_cover_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        at, mask, text = toxicity.layout([n], np.array([0]))
        assert set(at[mask > 0].tolist()) == set(range(n)) and len(text) >= 1


# -- 8 ------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def base_spans(t):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(k, m.group()))


def test_pii(spark, docs, small):
    g = random.Random(3)
    bits = ["a", "@", ".", "1", "2", "5", "-", " ", "+", "(", "_", "é", "25", "@x.y", "4111 1111 1111 1111"]
    noise = ["".join(g.choice(bits) for _ in range(g.randint(5, 60))) for _ in range(400)]
    noise += ["a@b.c_d@e.f", "a@b.cd@e.fg", "1.2.3.4.5.6.7.8", "x" * 5000 + "@a.b", "12" * 3000, "a.b@" + "c." * 3000 + "d"]
    made = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    for df in (made, docs, small):
        want = sorted(((d or -1, base_spans(t)) for d, t in pairs(df)), key=str)
        rows = pii.find(df).collect()
        assert sorted(((r["id"] or -1, [tuple(x) for x in r["base"]]) for r in rows), key=str) == want
        for r in rows:
            own = [tuple(x) for x in r["base"]] + [tuple(x) for x in r["added"]]
            assert all(a["e"] <= b["s"] for a, b in zip(r["added"], r["added"][1:])) and len(own) == len(set(own))
    assert pii.find(docs.limit(0)).count() == 0


def test_classifier_adds_secrets_and_ids_and_rejects_look_alikes(spark):
    g = random.Random(6)
    hexes = lambda n: "".join(g.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(g.choice("ABCDEFGHKLMNPQRSTuvwxyzabcdef0123456789") for _ in range(n))

    def account(good):
        body = f"{g.randrange(10**18):018d}"
        return f"DE{98 - int(body + '131400') % 97 + (0 if good else 1):02d}{body}"

    made = {
        True: [lambda: f'token = "{hexes(40)}"', lambda: f"api_key: {mixed(32)}1", lambda: f"password={mixed(20)}7", lambda: f"iban {account(True)}", lambda: f"ssn {g.randrange(100, 600)}-{g.randrange(10, 99)}-{g.randrange(1000, 9999)}"],
        False: [lambda: f"commit {hexes(40)} fixed", lambda: f"sha1 {hexes(40)}", lambda: "see reports/archive/pages/item2024/list", lambda: f"number {account(False)} there", lambda: f"order 000-{g.randrange(10, 99)}-{g.randrange(1000, 9999)}", lambda: "internationalization-2-of-everything"],
    }
    rows = []
    for k in range(1500):
        good = k % 2 == 0
        rows.append((k, "some words " + g.choice(made[good])() + " and more text", good))
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = {r["id"]: r["added"] for r in pii.find(df).collect()}
    found = {good: np.mean([len(got[k]) > 0 for k, _, y in rows if y == good]) for good in (True, False)}
    assert found[True] > 0.95 and found[False] < 0.03, [t for k, t, good in rows if not good and got[k]][:9]
    for k, t, good in rows:
        assert all(t[x["s"] : x["e"]] in t and not t[x["s"] : x["e"]].startswith(" ") for x in got[k])


def test_reliabilities():
    """Labelers of known reliability are told apart from one that guesses."""
    g = random.Random(4)
    votes = Counter()
    truth = {}
    for _ in range(4000):
        y = g.random() < 0.5
        b = tuple((1 if y == (g.random() < q) else -1) for q in (0.9, 0.9, 0.85, 0.5))
        votes[b] += 1
        truth.setdefault(b, []).append(y)
    p = pii.reliabilities(sorted(votes.items()))
    assert max(abs(p[b] - np.mean(truth[b])) for b in votes if votes[b] > 100) < 0.12
    assert pii.reliabilities([]) == {}


# -- 9 ------------------------------------------------------------------

def plain_lines(rows):
    shown = {}
    for d, t in rows:
        shown[d] = [(i, x.strip(WS)) for i, x in enumerate((t or "").split("\n")) if x.strip(WS)]
    first = {}
    for d in sorted(shown):
        for k in range(len(shown[d]) - 2):
            first.setdefault(tuple(x for _, x in shown[d][k : k + 3]), (d, k))
    out = {}
    for d, t in rows:
        gone = {i for k in range(len(shown[d]) - 2) if first[tuple(x for _, x in shown[d][k : k + 3])] < (d, k) for i, _ in shown[d][k : k + 3]}
        out[d] = (len(gone), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone))
    return out


def test_lines(spark, docs):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n b\n\nc \nd\ne"), (3, "q\nq\nq\nq\nq"), (4, None), (5, ""), (6, "a\nb"), (7, "b\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"] or "") for r in lines.deduplicate_lines(df).collect()}
    assert got == plain_lines(rows)
    out = lines.deduplicate_lines(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert lines.deduplicate_lines(docs.limit(0)).count() == 0


# -- 10 -----------------------------------------------------------------

@pytest.mark.parametrize("source", ["docs", "small"])
def test_packing(request, source):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(source)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t in pairs(df):
        want[d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()] += 1
    got = packing.pack(df).toPandas()
    lengths = {}
    for s, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].iloc[0] == 0 and (g["offset"].values[1:] == (g["offset"] + g["length"]).values[:-1]).all()
        lengths[s] = int(g["length"].sum())
    total = sum(lengths.values())
    assert total == sum(len(x) // 4 * n for (_, x), n in want.items())
    assert set(lengths) == set(range(len(lengths)))
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values()) and sum(n == 4096 for n in lengths.values()) == total // 4096
    pieces = Counter((None if x != x else int(x), s, n, c) for x, s, n, c in got[["id", "start", "length", "ids_crc32"]].itertuples(index=False))
    for d, ids in want:
        mine = sorted((s, n) for k, s, n, _ in pieces if k == d)
        assert mine[0][0] == 0
        for s, n in mine:
            if len([k for k, _ in want if k == d]) == 1:
                assert pieces[d, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])]
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_keep_the_mix():
    plan = packing.Schedule([400_000, 100_000, 50_000, 3_000], 4096, 16)
    seen = defaultdict(Counter)
    for q, total in enumerate(plan.totals.tolist()):
        for _, n, seq, _ in plan.cut(*plan.pieces(q, 0, total)):
            seen[seq][q] += n
    for seq in range(plan.all // 4096):
        for q, total in enumerate(plan.totals.tolist()):
            assert abs(seen[seq][q] - 4096 * total / plan.all) <= 16 * (len(plan.totals) + 1)


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer(), 50)
    for t in ["a<|endoftext|> b", "e ́ x", "don't 12 's 3rd x y\u0085z", "日本語 テスト", "", " İstanbul ﬁ   z", "́a ḅ́", "ΑΣ ΟΔΟΣ.", "I'LL we've '' ½ x²", "\x1ca\x1db"] * 2:
        assert ids.encode(pa.array([t]), 2)[0].tolist() == tok.encode(t, add_special_tokens=False).ids + [2]


def test_plain_words_need_no_normal_form():
    for c in map(chr, range(0x21, 0x250)):
        if re.fullmatch(packing.PLAIN, c):
            assert unicodedata.normalize("NFC", c) == c and pc.utf8_lower(pa.array([c]))[0].as_py() == c.lower()


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_split_words(most):
    texts = ["a b  a", None, "", " \t\n", "\x0bx\x0c y\r\x1cz\x85 é", "b"]
    out = []
    for lo, hi in text_slices(pa.array(texts), most):
        own, codes, counts = split_words(pa.array(texts)[lo:hi])
        assert len(set(own.to_pylist())) == len(own)
        flat = [own[int(c)].as_py() for c in codes]
        for n in counts.tolist():
            out.append(flat[:n])
            flat = flat[n:]
    assert out == [words(t) for t in texts] and list(text_slices(pa.array([], pa.string()))) == []


# -- pipeline -----------------------------------------------------------

def test_pipeline(spark, docs, sf_dir, tmp_path):
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    assert now.count()
    assert corpus_pipeline.run(spark, sf_dir).count()


def edited(g, ws, part):
    """The words with so many of them changed that about ``part`` of five-word shingles stay."""
    out = list(ws)
    for i in g.sample(range(0, len(out), 5), round((1 - part) * len(out) / 5)):
        out[i] = f"new{g.randrange(10**9)}"
    return out


def test_near_copies_are_those_of_brute_force(spark):
    g = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{g.randrange(3000)}" for _ in range(g.randrange(60, 400))]
        rows += [base, *(edited(g, base, part) for part in (0.97, 0.92, 0.9, 0.88, 0.8))]
    # A large group around one text, whose members are less alike among themselves.
    base = [f"v{g.randrange(3000)}" for _ in range(200)]
    rows += [base, *(edited(g, base, 0.9) for _ in range(80))]
    # Short and blank texts, which have one shingle or none.
    rows += [["a", "b"], ["a", "b"], ["a", "c"], [], []]
    texts = [" ".join(x) for x in rows]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                near += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert near > 300 and got == {i: find(i) for i in range(len(texts))}
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_near_copies_odd(docs):
    got = simhash.near_copies(docs).collect()
    one = {r["id"]: r["component_id"] for r in got}
    assert len(got) == docs.count() and one[1] == one[2] == 1 and one[8] == one[7] == 7 and one[4] == one[5] == one[6] == 4


def test_near_dedup_keeps_other_rows_of_an_id(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, long), (2, long), (2, "a text of its own here"), (None, long)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, df, sf_dir).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, long), (2, "a text of its own here"), (None, long)], key=str)


def test_rows_without_an_id_of_their_own_lose_only_their_lines(spark):
    seen, other = "\n".join(f"line {i}" for i in range(6)), "\n".join(f"other {i}" for i in range(9))
    rows = [(1, seen), (None, "top\n" + seen), (None, other), (7, "a\n" + seen), (7, other.upper())]
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, seen, 0), (None, "top", 6), (None, other, 0), (7, "a", 6), (7, other.upper(), 0)]
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got), key=str) == sorted(want, key=str)


def test_rows_without_an_id_of_their_own_lose_only_their_repeats(spark):
    seen, other = " ".join(f"s{i}" for i in range(40)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, seen), (None, "top " + seen), (None, other), (7, "a " + seen), (7, other.upper())]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, seen, 0), (None, "top", 40), (None, other, 0), (7, "a", 40), (7, other.upper(), 0)]
    assert sorted(((r["id"], r["kept"], r["n_removed"]) for r in got), key=str) == sorted(want, key=str)


def test_every_source_keeps_its_share_beyond_256(spark):
    n = 300
    df = spark.range(n * 30).select("id", (F.col("id") % n).alias("s"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.lit("the"))).alias("text"))
    df = df.select(F.col("id").alias("doc_id"), "text", F.concat(F.lit("s"), F.col("s").cast("string")).alias("source"))
    got = packing.pack(df).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in got)
    most = max(r["n"] for r in got if r["sequence_id"] < total // 4096)
    assert total == n * 30 * 61 and most <= 4096 / n + 32


def test_mix_takes_rows_without_an_id_of_their_own(spark, tmp_path):
    g = random.Random(8)
    rows = [(g.choice([None, k, k % 50]), " ".join(["w"] * g.randrange(1, 30)) + f" {k}", "abc"[k % 3]) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.mix_sources(spark, df, str(tmp_path)).collect()
    assert any(r["doc_id"] is None for r in got)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)


def test_exact_copies_without_an_id_on_one_side(spark):
    schema = "doc_id long, text string"
    old = spark.createDataFrame([(None, "same text"), (None, "same  text"), (1, "other")], schema)
    new = spark.createDataFrame([(5, "same text"), (6, "same text"), (7, "new")], schema)
    got = sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.deduplicate(new, old).collect()), key=str)
    assert got == sorted([(None, 5, 4, False), (None, 5, 4, False), (5, 5, 4, True), (6, 5, 4, False), (1, 1, 1, True), (7, 7, 1, True)], key=str)


def test_pipeline_follows_every_row(spark, tmp_path):
    """Each stage's rows against a plain version of it, with rows that share an id or have none."""
    from tokenizers import Tokenizer

    g = random.Random(21)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: "\n".join(" ".join(g.choice(vocab) for _ in range(g.randrange(4, 9))) for _ in range(n))
    shared = prose(4)
    rows = []
    for k in range(260):
        t = prose(g.randrange(1, 14)) if k >= 40 else " ".join(g.choice(vocab) for _ in range(g.randrange(60, 150)))
        t = t.replace(" ", " zorky ", 3) if k % 5 == 0 else t
        rows.append((g.choice([k, k, k, k // 3, None]), t if k % 4 else t + "\n" + shared, "en", g.choice(["a", "b", "c", None]), k))
    for k in range(40):
        ws = rows[k][1].split(" ")
        ws[len(ws) // 2] = f"edit{k}"
        rows.append((500 + k, " ".join(ws), "en", "a", k))
    rows += [(700, None, None, None, None), (701, "", "en", "b", 0)] + rows[:5]
    labels = [(k, 1, int(any(r[0] == k and "zorky" in (r[1] or "") for r in rows))) for k in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now, kept = docs, Counter((r[0], r[1], r[3]) for r in rows)
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = out[name] = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert now.columns == docs.columns
    read = lambda name: Counter((r["doc_id"], r["text"], r["source"]) for r in out[name].collect())

    p, vocab_of = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))[0]
    score = dict(zip([t for _, t, _ in kept], toxicity.scores(p, vocab_of, pa.array([t for _, t, _ in kept], pa.string()))))
    kept = Counter({x: n for x, n in kept.items() if score[x[1]] < 0.5})
    assert read("toxicity") == kept and 150 < sum(kept.values()) < len(rows)

    far = 1 << 62
    shown = {x: [(i, y.strip(WS)) for i, y in enumerate((x[1] or "").split("\n")) if y.strip(WS)] for x in kept}
    windows = lambda x: [(k, tuple(y for _, y in shown[x][k : k + 3])) for k in range(len(shown[x]) - 2)]
    first = {}
    for x in kept:
        for k, w in windows(x):
            first[w] = min(first.get(w, (far + 1, 0)), (far if x[0] is None else x[0], k))
    after = Counter()
    for x, n in kept.items():
        gone = {i for k, w in windows(x) if first[w] < (far if x[0] is None else x[0], k) for i, _ in shown[x][k : k + 3]}
        text = "\n".join(y for i, y in enumerate(x[1].split("\n")) if i not in gone) if gone else x[1]
        after[x[0], text, x[2]] += n
    assert read("line dedup") == after and after != kept

    rest = list(after)
    sets = [shingles((t or "").lower()) for _, t, _ in rest]
    root = list(range(len(rest)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rest)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(rest):
        least[find(i)] = min((v for v in (x[0], least.get(find(i))) if v is not None), default=None)
    kept = Counter({x: after[x] for i, x in enumerate(rest) if x[0] is None or x[0] == least[find(i)]})
    assert read("near dedup") == kept and sum(kept.values()) < sum(after.values()) - 10

    mixed, sizes, taken, most = read("mixing"), Counter(), Counter(), Counter()
    assert all(x in kept and n <= 2 * kept[x] for x, n in mixed.items())
    for x, n in kept.items():
        sizes[x[2]] += n * len(words(x[1]))
        taken[x[2]] += mixed[x] * len(words(x[1]))
        most[x[2]] = max(most[x[2]], len(words(x[1])))
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tokens = Counter()
    for (d, t, s), n in mixed.items():
        tokens[d, s] += n * (len(tok.encode(t or "", add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in out["packing"].collect():
        got[r["doc_id"], r["source"]] += r["length"]
    assert got == tokens
