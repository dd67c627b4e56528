"""Queries on density clusters, communities, brokers, fitted vocabularies, logs and counters."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.tables import shared_dir, store
from ..functions.text import tokens
from ..operators import counters, density, knn, network, reports, rules, tfidf
from .catalog import query, table
from .landscape import EDGES, PLANE, landscape_pca, plane, supplier_edges
from .texts import TFIDF, TOKENS, docs, weights

EPS, LEAST = 0.02, 5


@query("density_map", f"""WITH RECURSIVE {PLANE},
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM plane a JOIN plane b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}::DOUBLE),
core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= {LEAST}), link AS (SELECT n.a, n.b FROM near n JOIN core c ON c.a = n.a JOIN core d ON d.a = n.b),
r(node, other) AS (SELECT a, a FROM core UNION SELECT r.node, link.b FROM r JOIN link ON r.other = link.a), roots AS (SELECT node, min(other) AS root FROM r GROUP BY 1),
own AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots),
edge AS (SELECT n.a AS node, min(cluster) AS cluster FROM near n JOIN own o ON o.node = n.b WHERE n.a NOT IN (SELECT a FROM core) GROUP BY 1)
SELECT vec_id, coalesce(o.cluster, e.cluster, -1) AS cluster, o.node IS NOT NULL AS core FROM plane LEFT JOIN own o ON o.node = vec_id LEFT JOIN edge e ON e.node = vec_id""")
def density_map(spark, sf_dir):
    """Dense regions of the map of the first two dimensions, and noise between them."""
    return density.density_clusters(plane(spark, sf_dir), "vec_id", ["x", "y"], EPS, LEAST)


@query("density_landscape")
def density_landscape(spark, sf_dir):
    """Dense regions of the map on the main axes; the axes are found by iteration, so there is no SQL for it."""
    axes = store(landscape_pca(spark, sf_dir), "axes")
    found = density.density_clusters(axes, "vec_id", ["umap_x", "umap_y"], 2 * EPS, LEAST)
    return axes.join(found, "vec_id").select("vec_id", "umap_x", "umap_y", "cluster", "core")


STRONG = f"{EDGES}, k AS (SELECT a, b, n FROM e WHERE n >= (SELECT avg(n) FROM e) * 1.5)"


def strong_ties(spark, sf_dir, times=1.5):
    return network.strong(store(supplier_edges(spark, sf_dir), "ties"), times)


@query("communities_modular")
def communities_modular(spark, sf_dir):
    """Groups of suppliers with more ties inside than by chance; a search, so there is no SQL for it."""
    return network.modular_communities(strong_ties(spark, sf_dir, 1.05))


@query("brokerage", f"""WITH {STRONG}, l AS (SELECT a AS i, b AS j, n FROM k UNION ALL SELECT b, a, n FROM k),
sh AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM l), t AS (SELECT x.i, y.j, sum(x.p * y.p) AS q FROM sh x JOIN sh y ON x.j = y.i JOIN sh z ON z.i = x.i AND z.j = y.j GROUP BY 1, 2)
SELECT sh.i AS node, round(sum((p + coalesce(q, 0)) * (p + coalesce(q, 0))), 6) AS "constraint" FROM sh LEFT JOIN t ON t.i = sh.i AND t.j = sh.j GROUP BY 1""")
def brokerage(spark, sf_dir):
    """How far each supplier's strong ties lead back to one another."""
    return network.constraint(strong_ties(spark, sf_dir))


@query("betweenness_pivots")
def betweenness_pivots(spark, sf_dir):
    """Suppliers between others, estimated from the shortest paths of 32 of them; paths are counted level by level, so there is no SQL for it."""
    return network.betweenness(strong_ties(spark, sf_dir, 1.05), 32)


@query("tfidf_fitted", rf"""WITH {TFIDF}, new AS (SELECT conv_id || '-' || turn AS id, text FROM conversations),
ntf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS}) AS term FROM new) GROUP BY 1, 2), nraw AS (SELECT id, term, tf * idf AS w FROM ntf JOIN idf USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM nraw""")
def tfidf_fitted(spark, sf_dir):
    """Weights of the turns of conversations by the vocabulary of the documents, fitted and stored once."""
    vocabulary = store(tfidf.fit(docs(spark, sf_dir), "doc_id", tokens(F.col("text"))), "vocabulary")
    new = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return tfidf.transform(new, vocabulary, "id", tokens(F.col("text"))).select("id", "term", F.round("weight", 6).alias("weight"))


@query("topic_keywords")
def topic_keywords(spark, sf_dir):
    """Eight topics of the documents by k-means over their weights, and each topic's terms; the search has no SQL."""
    lists = docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("toks"))
    # Stored, since the search reads it several times; whole numbers take little room.
    counts = store(HashingTF(inputCol="toks", outputCol="tf", numFeatures=256).transform(lists).select("doc_id", "tf"), "counts")
    v = Normalizer(inputCol="tf", outputCol="v").transform(counts)
    topics = KMeans(k=8, seed=7, featuresCol="v", predictionCol="topic").fit(v).transform(v).select("doc_id", "topic")
    return tfidf.cluster_terms(weights(spark, sf_dir), store(topics, "topics"), "doc_id", "topic", 8)


@query("cooccur_support", f"""WITH d AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents), n AS (SELECT count(*) AS docs FROM documents),
v AS (SELECT term, count(*) AS df FROM d GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT docs FROM n) AND count(*) <= 0.5 * (SELECT docs FROM n)), k AS (SELECT doc_id, term, df FROM d JOIN v USING (term))
SELECT x.term AS a, y.term AS b, count(*) AS n, round(count(*) / (any_value(x.df) + any_value(y.df) - count(*)), 6) AS jaccard
FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT docs FROM n)""")
def cooccur_support(spark, sf_dir):
    """Terms that share at least 2 of 100 documents, terms of over half of them aside."""
    return network.term_pairs(docs(spark, sf_dir), "doc_id", tokens(F.col("text")), 0.02, 0.5)


@query("snapshot_log", """WITH b AS (SELECT 'S' || item_id AS id, substring(text, 1, 40) AS title, length(text) % 3 = 0 AS early FROM benchmark),
l AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY id) + CASE WHEN early THEN 0 ELSE (SELECT count(*) FROM b WHERE early) END AS ordinal FROM b)
SELECT ordinal, id, title FROM l""")
def snapshot_log(spark, sf_dir):
    """Snapshots with string ids appended to a log twice over: some first, then all, numbered on."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("S"), "item_id").alias("id"), F.substring("text", 1, 40).alias("title"), (F.length("text") % 3 == 0).alias("early"))
    log = numbered(items.where("early").drop("early"), "id", "ordinal")
    items = items.drop("early")
    return reports.append_new(reports.append_new(log, items), items.union(items)).select("ordinal", "id", "title")


@query("import_counters", """SELECT unnest(['rows', 'malformed', 'unnamed']) AS counter,
unnest([count(*), count(*) FILTER (WHERE n_chars <> length(text)), count(*) FILTER (WHERE coalesce(source, '') = '')]) AS n FROM documents""")
def import_counters(spark, sf_dir):
    """What an import of the documents counts while it writes them."""
    d = docs(spark, sf_dir)
    c = counters.Counters(d, malformed=F.col("n_chars") != F.length("text"), unnamed=F.coalesce("source", F.lit("")) == "")
    return counters.written(spark, c, lambda rows: store(rows, "imported")).where("counter <> 'elapsed_ms'")


RULES = {
    "and": {"all": ["the", "with", {"not": "from"}]}, "or": {"any": ["que", "und"]}, "adjacent": {"adjacent": ["the", "of"], "within": 2}, "near": {"near": ["with", "from"], "within": 3},
    "nested": {"all": [{"any": [{"phrase": ["of", "the"]}, "und"]}, {"not": {"near": ["the", "and"], "within": 2}}]}, "none": {"not": {"any": ["the", "que"]}},
}
_W = "[^ ]+ "
RULES_SQL = rf"""WITH t AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS s FROM documents)
SELECT 'and' AS rule, doc_id FROM t WHERE s LIKE '% the %' AND s LIKE '% with %' AND NOT s LIKE '% from %'
UNION ALL SELECT 'or', doc_id FROM t WHERE s LIKE '% que %' OR s LIKE '% und %'
UNION ALL SELECT 'adjacent', doc_id FROM t WHERE regexp_matches(s, ' the ({_W}){{0,1}}of ')
UNION ALL SELECT 'near', doc_id FROM t WHERE regexp_matches(s, ' with ({_W}){{0,2}}from ') OR regexp_matches(s, ' from ({_W}){{0,2}}with ')
UNION ALL SELECT 'nested', doc_id FROM t WHERE (s LIKE '% of the %' OR s LIKE '% und %') AND NOT (regexp_matches(s, ' the ({_W}){{0,1}}and ') OR regexp_matches(s, ' and ({_W}){{0,1}}the '))
UNION ALL SELECT 'none', doc_id FROM t WHERE NOT (s LIKE '% the %' OR s LIKE '% que %')"""


@query("rules_as_data", RULES_SQL)
def rules_as_data(spark, sf_dir):
    """The documents that each of six rules fits, in one reading of the texts."""
    d = docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    hits = F.array_compact(F.array(*[F.when(rules.matches(F.col("t"), r), name) for name, r in RULES.items()]))
    return d.select(F.explode(hits).alias("rule"), "doc_id")


@query("rules_index", RULES_SQL)
def rules_index(spark, sf_dir):
    """The same from an index of the texts' words."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    rules.write_index(docs(spark, sf_dir), "doc_id", tokens(F.col("text")), path)
    found = [rules.search(spark, path, r).select(F.lit(name).alias("rule"), F.col("key").alias("doc_id")) for name, r in RULES.items()]
    return reduce(lambda a, b: a.union(b), found)


@query("landscape_neighbours")
def landscape_neighbours(spark, sf_dir):
    """A map of the embeddings that keeps neighbours together, from that of the main axes; found by iteration, so there is no SQL for it."""
    start = landscape_pca(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    found = store(knn.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "neighbours")
    at = knn.layout(start, found)
    return at.select(F.col("id").alias("vec_id"), F.round("x", 6).alias("umap_x"), F.round("y", 6).alias("umap_y"))
