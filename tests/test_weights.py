import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orrery.functions.text import tokens
from orrery.operators import prompts, tfidf


def written(spark, f):
    """Bytes that f's jobs shuffle."""
    def total():
        every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = total()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def shuffled(spark, name):
    """What a query shuffles, as a multiple of its documents."""
    d = "/root/testdata/sf0.01"
    return written(spark, lambda: entry.queries()[name](spark, d).write.format("noop").mode("overwrite").save()) / os.path.getsize(f"{d}/documents.parquet")


def plain(rows, min_df, max_df):
    """{(key, term): weight}, text by text."""
    tf = {}
    for key, text in rows:
        tf.setdefault(key, Counter()).update(re.findall(r"\w{2,}", (text or "").lower()))
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(rows)}
    out = {}
    for key, c in tf.items():
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        out |= {(key, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    return out


TEXTS = [(i, f"common w{i % 3} {f'pair{i // 2} ' * (1 + i % 2)} w{i % 5} w{i % 3} only{i}") for i in range(40)]


@pytest.mark.parametrize("more", [[], [(3, "w1 again pair1"), (3, "w1 w2"), (None, "w0 pair5 pair5"), (None, "pair5"), (90, None)]])
@pytest.mark.parametrize("frequent", [1 << 17, 4, 1])
def test_weights_of_frequent_and_rare_terms(spark, monkeypatch, more, frequent):
    """Also where keys repeat or are missing: their texts count as one."""
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)
    rows = TEXTS + more
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf(df, "id", tokens(F.col("text")), 2, 0.8).collect()}
    want = plain(rows, 2, 0.8)
    assert got.keys() == want.keys() and not any(t == "common" for _, t in got)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("frequent", [1 << 17, 3000])
def test_terms_are_not_shuffled_with_each_document(spark, monkeypatch, frequent):
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)
    assert shuffled(spark, "tfidf") < 3


def test_topics_take_no_table_of_weights(spark):
    assert shuffled(spark, "topic_keywords") < 3.5


def test_prompts_shuffle_only_the_texts_that_they_show(spark):
    assert shuffled(spark, "cluster_prompts") < 3.5


def test_prompts_of_texts_in_a_table_of_their_own(spark):
    """As from one table; a text that is missing leaves its line empty, and one that is there twice doesn't move the centre."""
    at = spark.createDataFrame([(i, i % 2, float(i), 0.0) for i in range(8)], "id long, c int, x double, y double")
    texts = spark.createDataFrame([(i, f"text\n{i}") for i in range(7)], "id long, text string")
    terms = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "c int, rank int, term string")
    both = [prompts.cluster_prompts(at.join(texts, "id", "left"), "c", "id", ["text"], terms, 3), prompts.cluster_prompts(at, "c", "id", ["text"], terms, 3, source=texts)]
    one, two = ({r["c"]: r["prompt"] for r in d.collect()} for d in both)
    assert one == two and one[0].startswith("Cluster 0:\nTerms: a, b\nDocuments:\n  - text ")
    twice = prompts.cluster_prompts(at, "c", "id", ["text"], terms, 3, source=texts.union(texts.where("id = 6"))).collect()
    assert {x for r in twice for x in r["prompt"].split("\n")} == {x for p in one.values() for x in p.split("\n")}


def test_rows_of_prompts_shuffle_only_the_texts_that_they_show(spark):
    assert shuffled(spark, "cluster_prompt_rows") < 3.5
