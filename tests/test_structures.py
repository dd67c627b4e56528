"""Clusters, communities, brokers, logs, fitted vocabularies and counters against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.functions.ordering import numbered
from orrery.functions.text import tokens
from orrery.operators import counters, density, labels, network, reports, stopwords, tfidf
from orrery.sources import readers
from orrery.streaming import ingest
from orrery.streaming import log as logs


def plain_clusters(rows, eps, least):
    """{key: (cluster, core)} over all pairs of (key, point)."""
    ok = [(k, p) for k, p in rows if all(x is not None and math.isfinite(x) for x in p)]
    near = [[j for j, (_, q) in enumerate(ok) if sum((a - b) * (a - b) for a, b in zip(p, q)) <= eps * eps] for _, p in ok]
    core, root = [len(n) >= least for n in near], list(range(len(ok)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, n in enumerate(near):
        for j in n:
            if core[i] and core[j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    first = {}
    for i in range(len(ok)):
        if core[i]:
            first[find(i)] = min(first.get(find(i), ok[i][0]), ok[i][0])
    number = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    out = {k: (-1, False) for k, _ in rows}
    for i, (k, _) in enumerate(ok):
        homes = [number[find(j)] for j in near[i] if core[j]]
        if homes:
            out[k] = (number[find(i)], True) if core[i] else (min(homes), False)
    return out


@pytest.mark.parametrize("dims, eps, least, n", [(2, 0.02, 5, 700), (1, 0.01, 4, 300), (3, 0.1, 5, 500), (2, 0.3, 6, 500)])
def test_density(spark, dims, eps, least, n):
    """Dense and thin cells, equal places, bounds met exactly, borders, noise, and rows without a place."""
    g, rows = random.Random(dims + n), []
    for k in range(n):
        c = g.choice([(0, 0, 0), (0.15, 0.1, 0), (1, 1, 1)])
        rows.append((k, tuple(round(g.gauss(c[i], 0.05), g.choice([1, 2, 3, 9])) if g.random() < 0.8 else g.uniform(-1, 2) for i in range(dims))))
    rows += [(n, (None,) * dims), (n + 1, (math.nan,) * dims), (n + 2, (math.inf,) * dims)]
    df = spark.createDataFrame([(k, *p) for k, p in rows], "k long," + ",".join(f"x{i} double" for i in range(dims)))
    got = {r["k"]: (r["cluster"], r["core"]) for r in density.density_clusters(df, "k", [f"x{i}" for i in range(dims)], eps, least).collect()}
    assert got == plain_clusters(rows, eps, least)


def test_density_of_one_place_and_nothing(spark):
    """Half of all rows at one place are one cluster; no rows, or noise alone, give none."""
    df = spark.createDataFrame([(i, 0.5 if i % 2 else float(i), 0.5) for i in range(400)], "k string, x double, y double")
    got = {r["k"]: r["cluster"] for r in density.density_clusters(df, "k", ["x", "y"], 0.1, 3).collect()}
    assert all(got[str(i)] == (0 if i % 2 else -1) for i in range(400))
    assert density.density_clusters(df.limit(0), "k", ["x", "y"], 0.1, 3).count() == 0


def graph(spark, weights):
    return spark.createDataFrame([(a, b, n) for (a, b), n in sorted(weights.items())], "a long, b long, n long")


def planted(seed, groups, size, inside, outside):
    g, out = random.Random(seed), {}
    for a, b in itertools.combinations(range(groups * size), 2):
        if g.random() < (inside if a // size == b // size else outside):
            out[a, b] = g.randrange(1, 4)
    return out


def plain_modularity(weights, of):
    m, deg = sum(weights.values()), Counter()
    for (a, b), n in weights.items():
        deg[of[a]] += n
        deg[of[b]] += n
    return sum(n for (a, b), n in weights.items() if of[a] == of[b]) / m - sum(d * d for d in deg.values()) / (2 * m) ** 2


def plain_louvain(weights):
    """Nodes one after the other, then communities as nodes, till nothing moves."""
    links = defaultdict(Counter)
    for (a, b), n in weights.items():
        links[a][b] += n
        links[b][a] += n
    of, m = {x: x for x in links}, sum(weights.values())
    names = dict(of)
    while True:
        here, k, moved = {x: x for x in links}, {x: sum(links[x].values()) for x in links}, False
        tot = Counter(k)
        again = True
        while again:
            again = False
            for x in sorted(links):
                to = Counter()
                for y, n in links[x].items():
                    if y != x:
                        to[here[y]] += n
                tot[here[x]] -= k[x]
                best = max([here[x], *to], key=lambda c: (to[c] - tot[c] * k[x] / (2 * m), c == here[x]))
                if best != here[x]:
                    again = moved = True
                here[x] = best
                tot[best] += k[x]
        names = {x: here[c] for x, c in names.items()}
        if not moved:
            return names
        new = defaultdict(Counter)
        for x, ys in links.items():
            for y, n in ys.items():
                new[here[x]][here[y]] += n
        links = new


@pytest.mark.parametrize("weights", [planted(1, 5, 12, 0.6, 0.04), planted(2, 8, 8, 0.9, 0.02), {(i, i + 1): 1 for i in range(30)}, {**{(0, i): 1 for i in range(1, 20)}, (1, 2): 5}])
def test_modular_communities(spark, weights):
    """Not worse than a plain search, the same again, and the sum that is meant."""
    got = {r["node"]: r["community"] for r in network.modular_communities(graph(spark, weights)).collect()}
    assert set(got) == {x for e in weights for x in e} and all(min(x for x in got if got[x] == c) == c for c in got.values())
    assert plain_modularity(weights, got) >= plain_modularity(weights, plain_louvain(weights)) - 0.01
    labels = spark.createDataFrame(list(got.items()), "node long, community long")
    assert abs(network.modularity(network.both_ways(graph(spark, weights)), labels) - plain_modularity(weights, got)) < 1e-9


def test_modular_communities_are_stable(spark):
    weights = planted(1, 5, 12, 0.6, 0.04)
    a, b = (sorted(map(tuple, network.modular_communities(graph(spark, weights).repartition(n)).collect())) for n in (1, 3))
    assert a == b and network.modular_communities(graph(spark, weights).limit(0)).count() == 0


def test_constraint(spark):
    """Over all triples, with a hub of many ties."""
    weights = planted(3, 3, 9, 0.7, 0.1) | {(0, 100 + i): 1 + i % 3 for i in range(40)}
    w = defaultdict(dict)
    for (a, b), n in weights.items():
        w[a][b] = w[b][a] = n
    share = {a: {b: n / sum(v.values()) for b, n in v.items()} for a, v in w.items()}
    want = {i: round(sum((share[i][j] + sum(share[i][q] * share[q].get(j, 0) for q in share[i] if q != j)) ** 2 for j in share[i]), 6) for i in share}
    got = {r["node"]: r["constraint"] for r in network.constraint(graph(spark, weights)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_betweenness_from_pivots(spark):
    """Exact from all nodes; from half of them within the bound that the docstring states; nodes without any stay."""
    weights = planted(4, 3, 8, 0.6, 0.08)
    df = graph(spark, weights)
    exact = {r["node"]: r["betweenness"] for r in network.betweenness(df).collect()}
    n = len(exact)
    assert exact == {r["node"]: r["betweenness"] for r in network.betweenness(df, n).collect()}
    part = {r["node"]: r["betweenness"] for r in network.betweenness(df, n // 2).collect()}
    e = math.sqrt(math.log(2 * n / 0.01) / (2 * (n // 2)))
    assert part.keys() == exact.keys() and max(abs(part[x] - exact[x]) for x in exact) <= e * n * (n - 2) / 2
    assert 0 < sum(part.values()) < 2 * sum(exact.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered_by_strings(spark, parts):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(1).sample(range(300), 300)], "id string")
    assert all(int(r["id"][1:]) + 1 == r["n"] for r in numbered(df, "id", "n", parts).collect())


def test_log_of_string_ids_survives_replays(spark, tmp_path):
    """Batches of a stream, one offered again, one that repeats ids: each id is numbered once and keeps its fields."""
    schema = spark.createDataFrame([], "id string, title string").schema
    path = str(tmp_path / "log")
    logs.create_log(spark, path, schema)
    batches = [[("b", "1"), ("a", "1")], [("a", "late"), ("c", "2"), ("c", "1"), (None, "none")], [("z", "3"), ("b", "late")]]
    append = logs.appender(path, schema)
    frames = [spark.createDataFrame(b, schema) for b in batches]
    read = lambda: sorted((r["ordinal"], r["id"], r["title"]) for r in logs.read_log(spark, path, schema).collect())
    append(frames[0], 0)
    append(frames[0], 0)
    append(frames[1], 1)
    want = [(1, "a", "1"), (2, "b", "1"), (3, "c", "1")]
    assert read() == want
    append(frames[2], 2)
    append(frames[2], 2)
    append(frames[1], 1)
    logs.create_log(spark, path, schema)
    assert read() == [*want, (4, "z", "3")]


def test_log_under_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, title string").schema
    path, src = str(tmp_path / "log"), str(tmp_path / "src")
    logs.create_log(spark, path, schema)
    for k in range(3):
        spark.createDataFrame([(f"s{i}", str(k)) for i in range(k, k + 3)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(logs.appender(path, schema)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination()
    got = sorted((r["ordinal"], r["id"], r["title"]) for r in logs.read_log(spark, path, schema).collect())
    assert got == [(1, "s0", "0"), (2, "s1", "0"), (3, "s2", "0"), (4, "s3", "1"), (5, "s4", "2")]
    assert reports.append_new(logs.read_log(spark, path, schema).drop("batch"), spark.createDataFrame([("s0", "x")], schema)).count() == 5


def test_streamed_weights_are_the_batch_weights(spark, sf_dir, tmp_path):
    """A vocabulary fitted and stored once gives the corpus its own weights, in batch and batch by batch in a stream."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    toks = tokens(F.col("text"))
    tfidf.fit(docs, "doc_id", toks).write.parquet(str(tmp_path / "vocabulary"))
    vocabulary = spark.read.parquet(str(tmp_path / "vocabulary"))
    rounded = lambda df: sorted((r["doc_id"], r["term"], round(r["weight"], 9)) for r in df.select("doc_id", "term", "weight").collect())
    want = rounded(tfidf.tfidf(docs, "doc_id", toks))
    assert want and rounded(tfidf.transform(docs, vocabulary, "doc_id", toks)) == want
    docs.repartition(3).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    out = str(tmp_path / "weights")
    stream.writeStream.foreachBatch(ingest.weight_writer(out, vocabulary, "doc_id", toks)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rounded(spark.read.parquet(out)) == want
    new = spark.createDataFrame([(1, "nothing known qqqq"), (2, None)], "doc_id long, text string")
    assert tfidf.transform(new, vocabulary, "doc_id", toks).count() == 0


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(100)], "id long, v string").repartition(4)
    c = counters.Counters(df, malformed=F.col("v").isNull(), late=F.col("id") > 90)
    got = {r["counter"]: r["n"] for r in counters.written(spark, c, lambda d: d.write.parquet(str(tmp_path / "out"))).collect()}
    assert got.pop("elapsed_ms") > 0 and got == {"rows": 100, "malformed": 34, "late": 9}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_words_are_exported_in_order(spark, tmp_path):
    stopwords.export(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("é", 4)], "word string, n int"), str(tmp_path / "words"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "words")).collect()]
    assert lines == ["a", "b", "é"] and sorted(r["word"] for r in readers.read_words(spark, str(tmp_path / "words")).collect()) == lines


@pytest.mark.parametrize("written", [False, True])
def test_published_tables_answer_sql(spark, tmp_path, written):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    readers.publish(df, "offered", str(tmp_path / "offered") if written else None)
    assert sorted(map(tuple, spark.sql("SELECT v, id FROM offered").collect()), key=str) == sorted([("x", 1), (None, 2)], key=str)
    assert spark.sql("SELECT count(v) AS n FROM offered").first()["n"] == 1


def test_labels_for_an_editor(spark):
    rows = [(3, "[3] c"), (-1, "noise"), (10, "[10] k"), (0, labels.PLACEHOLDER), (1, "[1] a")]
    got = [r["cluster_id"] for r in labels.editable(spark.createDataFrame(rows, "cluster_id int, label string")).collect()]
    assert got == [1, 3, 10, -1]


def test_default_lists_by_language(spark):
    got = {r["word"] for r in stopwords.defaults(spark, "de", "fr").collect()}
    assert {"und", "les", "des"} <= got and "the" not in got and got <= {r["word"] for r in stopwords.defaults(spark).collect()}


def test_each_file_has_its_charset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,x\n電池,1\n".encode())
    (tmp_path / "b.csv").write_bytes("名,x\n材料,2\n".encode("shift_jis"))
    assert sorted(readers.verdicts(spark, str(tmp_path)).values()) == [False, True]
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect())) == sorted([("電池", "1"), ("材料", "2")])
