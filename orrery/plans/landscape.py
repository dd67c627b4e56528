"""Queries on clusters, maps, terms in context and networks."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.ordering import join_reduced
from ..functions.tables import small, store
from ..functions.text import tokens
from ..operators import growth, labels, network, prompts, search, summary, tfidf, vectors
from .catalog import query, table
from .texts import TFIDF, TOKENS


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def plane(spark, sf_dir):
    """The first two dimensions as a map."""
    return embeddings(spark, sf_dir).select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


PLANE = "plane AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
CELLS = "cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), mid AS (SELECT label, dim, avg(x) AS cx FROM cells GROUP BY 1, 2)"


@query("distinct_clusters", "SELECT DISTINCT label FROM embeddings WHERE label <> -1")
def distinct_clusters(spark, sf_dir):
    return embeddings(spark, sf_dir).where(F.col("label") != labels.NOISE).select("label").distinct()


@query("cluster_centroid", f"WITH {CELLS} SELECT label, dim::INT AS dim, round(cx, 6) AS value FROM mid")
def cluster_centroid(spark, sf_dir):
    return vectors.centroids(embeddings(spark, sf_dir), "label", "embedding").select("label", F.posexplode("centroid").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("value"))


@query("representatives", f"WITH {CELLS}, s AS (SELECT label, vec_id, round(sum(x * cx), 6) AS score FROM cells JOIN mid USING (label, dim) GROUP BY 1, 2) SELECT * FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5")
def representatives(spark, sf_dir):
    return vectors.representatives(embeddings(spark, sf_dir), "label", "vec_id", "embedding")


@query("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS first FROM embeddings")
def unit_vectors(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("length"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("xy_centroid", f"WITH {PLANE} SELECT label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM plane GROUP BY 1")
def xy_centroid(spark, sf_dir):
    return plane(spark, sf_dir).groupBy("label").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


NEAREST = f"{PLANE}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM plane GROUP BY 1), d AS (SELECT label, vec_id, round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 6) AS distance FROM plane JOIN c USING (label)), near5 AS (SELECT * FROM (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INT AS rank FROM d) WHERE rank <= 5)"


@query("nearest_to_centroid", f"WITH {NEAREST} SELECT * FROM near5")
def nearest_to_centroid(spark, sf_dir):
    p = plane(spark, sf_dir)
    return vectors.nearest_in_plane(p, "label", "vec_id", *vectors.coordinate_columns(p))


@query("cluster_prompt_rows", f"""WITH {TFIDF}, {NEAREST},
m AS (SELECT label, term, round(sum(weight) / any_value(size), 6) AS weight FROM tfidf JOIN embeddings ON vec_id = doc_id JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) USING (label) GROUP BY 1, 2),
t AS (SELECT label, string_agg(term, ', ' ORDER BY weight DESC, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS r FROM m WHERE weight > 0) WHERE r <= 10 GROUP BY 1),
x AS (SELECT label, string_agg('- ' || substring(translate(text, chr(10), ' '), 1, 200) || '...', chr(10) ORDER BY rank) AS texts FROM near5 JOIN documents ON vec_id = doc_id GROUP BY 1)
SELECT label, 'Cluster ' || label || chr(10) || 'Terms: ' || terms || chr(10) || texts AS prompt FROM t JOIN x USING (label)""")
def cluster_prompt_rows(spark, sf_dir):
    """For each cluster the text that asks for its name: terms and five texts nearest to its centre."""
    from ..functions.text import flatten_snippet

    docs, e = table(spark, sf_dir, "documents"), embeddings(spark, sf_dir)
    terms = tfidf.cluster_terms(tfidf.tfidf(docs, "doc_id", tokens(F.col("text"))), e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "label")
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda r: r[c]), sep)
    terms = terms.groupBy("label").agg(joined("term", ", ").alias("terms"))
    near = store(vectors.nearest_in_plane(plane(spark, sf_dir), "label", "vec_id", "x", "y"), "nearest")
    near = small(near, prompts.ROW_BYTES).join(docs, F.col("vec_id") == F.col("doc_id"))
    texts = near.select("label", "rank", F.concat(F.lit("- "), flatten_snippet(F.col("text"))).alias("line")).groupBy("label").agg(joined("line", "\n").alias("texts"))
    return terms.join(texts, "label").select("label", F.concat(F.lit("Cluster "), F.col("label").cast("string"), F.lit("\nTerms: "), "terms", F.lit("\n"), "texts").alias("prompt"))


SUMMARY_ROWS = """(SELECT label, vec_id, embedding, CASE WHEN label < 3 THEN NULL ELSE substring(text, 1, 30) END AS title, CASE WHEN label < 2 OR (doc_id % 5 = 0 AND label > 6) THEN NULL ELSE text END AS abstract,
  CASE WHEN label <> 4 THEN (2015 + (doc_id * doc_id) % 8)::INT END AS year, [lang, CASE WHEN doc_id % 2 = 0 THEN source END, 'nan'] AS parties FROM embeddings JOIN documents ON vec_id = doc_id)"""


@query("rich_summary", rf"""WITH d AS {SUMMARY_ROWS},
cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM d), mid AS (SELECT label, dim, avg(x) AS cx FROM cells GROUP BY 1, 2),
s AS (SELECT label, vec_id, round(sum(x * cx), 6) AS score FROM cells JOIN mid USING (label, dim) GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5),
p AS (SELECT vec_id, label, rank, title, abstract, year, array_to_string(list_filter(parties, lambda x: x IS NOT NULL AND x <> '' AND x <> 'nan'), ', ') AS party FROM r JOIN d USING (vec_id, label)),
l AS (SELECT label, rank, title IS NULL AND abstract IS NULL AS bad, '- 【' || replace(coalesce(title, 'No Title'), chr(10), ' ') || '】 (' || coalesce(year::VARCHAR, 'N/A') || ', ' || CASE WHEN length(party) > 30 THEN substring(party, 1, 30) || '...' ELSE party END || ') ' || substring(replace(coalesce(abstract, 'No Abstract'), chr(10), ' '), 1, 200) || '...' AS line FROM p),
reps AS (SELECT label, CASE WHEN avg(bad::INT) > 0.5 THEN '' ELSE string_agg(line, chr(10) ORDER BY rank) END AS representatives FROM l GROUP BY 1),
counts AS (SELECT label, year, count(*) AS n FROM d WHERE year IS NOT NULL GROUP BY 1, 2),
t AS (SELECT label, count(*) AS years, regr_slope(n, year) AS s, pow(arg_max(n, year)::DOUBLE / arg_min(n, year), 1.0 / greatest(1, max(year) - min(year))) - 1 AS g FROM counts GROUP BY 1),
trend AS (SELECT label, printf('%.1f%%', CASE WHEN years < 2 THEN 0.0 ELSE g END * 100) AS cagr, CASE WHEN years < 2 THEN 'stable' WHEN s > 0.5 THEN 'surge' WHEN s > 0 THEN 'up' WHEN s > -0.5 THEN 'down' ELSE 'stall' END AS trend FROM t),
party AS (SELECT label, p, count(*) AS n FROM (SELECT label, unnest(parties) AS p FROM d) WHERE p IS NOT NULL GROUP BY 1, 2),
hhi AS (SELECT label, round(sum(n * n) / pow(sum(n), 2), 6) AS hhi FROM party GROUP BY 1)
SELECT label, coalesce(cagr, 'N/A') AS cagr, coalesce(trend, 'N/A') AS trend, hhi, CASE WHEN hhi < 0.10 THEN 'competitive' WHEN hhi < 0.18 THEN 'moderate' ELSE 'concentrated' END AS hhi_status, representatives
FROM (SELECT DISTINCT label FROM d) LEFT JOIN trend USING (label) LEFT JOIN hhi USING (label) LEFT JOIN reps USING (label)""")
def rich_summary(spark, sf_dir):
    """The summary record of each cluster; some have neither titles nor abstracts, one has no years."""
    e = embeddings(spark, sf_dir).join(table(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"))
    d = e.select(
        "label", "vec_id", "embedding", F.when(F.col("label") >= 3, F.substring("text", 1, 30)).alias("title"), F.when(~((F.col("label") < 2) | ((F.col("doc_id") % 5 == 0) & (F.col("label") > 6))), F.col("text")).alias("abstract"),
        F.when(F.col("label") != 4, (2015 + F.col("doc_id") * F.col("doc_id") % 8).cast("int")).alias("year"), F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("nan")).alias("parties"),
    )
    d = d.withColumn("named", F.filter("parties", lambda x: x.isNotNull()))
    return summary.rich_summary(d, "label", "vec_id", "embedding", "title", "abstract", "year", "named").withColumn("representatives", F.array_join("representatives", "\n"))


@query("cluster_prompts", f"""WITH {TFIDF}, {NEAREST},
m AS (SELECT label, term, round(sum(weight) / any_value(size), 6) AS weight FROM tfidf JOIN embeddings ON vec_id = doc_id JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) USING (label) WHERE label <> 3 GROUP BY 1, 2),
t AS (SELECT label, string_agg(term, ', ' ORDER BY weight DESC, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS r FROM m WHERE weight > 0) WHERE r <= 10 GROUP BY 1),
x AS (SELECT label, string_agg('  - ' || concat_ws(' ', lang, translate(text, chr(10), ' ')), chr(10) ORDER BY rank) AS texts FROM near5 LEFT JOIN documents ON vec_id = doc_id WHERE label <> 5 GROUP BY 1)
SELECT CASE WHEN label = 5 THEN -1 ELSE label END::INT AS label, 'Cluster ' || label || ':' || chr(10) || 'Terms: ' || coalesce(terms, '') || chr(10) || 'Documents:' || chr(10) || texts AS prompt FROM x LEFT JOIN t USING (label)""")
def cluster_prompts(spark, sf_dir):
    """What asks for each cluster's name, of whole texts; the fifth cluster is taken as noise, the third has no terms."""
    docs, e = table(spark, sf_dir, "documents"), embeddings(spark, sf_dir)
    noise = F.when(F.col("label") == 5, labels.NOISE).otherwise(F.col("label"))
    terms = tfidf.cluster_terms(tfidf.tfidf(docs, "doc_id", tokens(F.col("text"))), e.where("label <> 3").select(F.col("vec_id").alias("doc_id"), noise.alias("label")), "doc_id", "label")
    rows, texts = plane(spark, sf_dir).withColumn("label", noise), docs.withColumnRenamed("doc_id", "vec_id")
    return prompts.cluster_prompts(rows, "label", "vec_id", ["lang", "text"], terms, source=texts)


@query("rep_suppression", "SELECT doc_id, lang, round(avg(CASE WHEN coalesce(quality, 0) = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lang), 6) AS invalid_share, avg(CASE WHEN coalesce(quality, 0) = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lang) > 0.5 AS suppressed FROM documents LEFT JOIN labels USING (doc_id)")
def rep_suppression(spark, sf_dir):
    """Whether a language's representatives are withheld: over half its documents lack a good label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", (F.coalesce("quality", F.lit(0)) == 0).cast("double").alias("bad"))
    share = d.groupBy("lang").agg(F.avg("bad").alias("share"))
    return join_reduced(d, share, "lang", "doc_id").select("doc_id", "lang", F.round("share", 6).alias("invalid_share"), (F.col("share") > 0.5).alias("suppressed"))


@query("label_apply", "SELECT vec_id, label, CASE WHEN label < 7 THEN '[' || label || '] topic of ' || count(*) OVER (PARTITION BY label) END AS label_text FROM embeddings")
def label_apply(spark, sf_dir):
    """Labels pasted as fenced JSON, made here from the clusters' sizes, put on each row."""
    e = embeddings(spark, sf_dir).select("vec_id", "label")
    sizes = e.where("label < 7").groupBy("label").agg(F.concat(F.lit("topic of "), F.count("*").cast("string")).alias("t"))
    pairs = F.concat(F.collect_list(F.struct(F.col("label").cast("string").alias("key"), "t")), F.array(F.struct(F.lit("x").alias("key"), F.lit("ignored").alias("t")), F.struct(F.lit("999").alias("key"), F.lit("unknown").alias("t"))))
    pasted = sizes.agg(F.concat(F.lit("```json\n"), F.to_json(F.map_from_entries(pairs)), F.lit("\n```")).alias("json"))
    return labels.apply(e, "label", labels.entries(pasted, "json"))


@query("label_merge", """WITH c AS (SELECT label AS cluster_id, 'old ' || label AS label FROM embeddings WHERE label % 2 = 0 GROUP BY embeddings.label UNION SELECT 77, 'kept for 77'),
p AS (SELECT label AS cluster_id, 'of ' || count(*) AS label FROM embeddings WHERE label < 7 GROUP BY embeddings.label UNION SELECT 77, 'new 77' UNION SELECT 999, 'unknown'),
n AS (SELECT * FROM p WHERE cluster_id IN (SELECT cluster_id FROM c) OR cluster_id IN (SELECT label FROM embeddings))
SELECT coalesce(c.cluster_id, n.cluster_id)::INT AS cluster_id, coalesce('[' || n.cluster_id || '] ' || n.label, c.label) AS label, CASE WHEN n.label IS NULL THEN 'kept' WHEN c.label IS NOT NULL THEN 'updated' ELSE 'added' END AS change FROM c FULL JOIN n ON c.cluster_id = n.cluster_id""")
def label_merge(spark, sf_dir):
    """Pasted labels put into a map that has some already, one of them of a cluster without rows."""
    e = embeddings(spark, sf_dir).select(F.col("label").alias("cluster_id"))
    extra = lambda rows: spark.createDataFrame(rows, "cluster_id int, label string")
    current = e.where("cluster_id % 2 = 0").distinct().select("cluster_id", F.concat(F.lit("old "), F.col("cluster_id").cast("string")).alias("label")).union(extra([(77, "kept for 77")]))
    pasted = e.where("cluster_id < 7").groupBy("cluster_id").agg(F.concat(F.lit("of "), F.count("*").cast("string")).alias("label")).union(extra([(77, "new 77"), (999, "unknown")]))
    return labels.merged(current, pasted, e)


@query("relabel", "SELECT CASE WHEN label >= 5 THEN label - 5 ELSE label END::INT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def relabel(spark, sf_dir):
    """Each cluster from 5 on merged into the one five below it."""
    e = embeddings(spark, sf_dir)
    mapping = e.where("label >= 5").select(F.col("label").alias("old"), (F.col("label") - 5).alias("new")).distinct()
    return labels.merge(e, "label", mapping).groupBy("label").agg(F.count("*").alias("n"))


@query("drilldown", f"WITH {PLANE} SELECT CASE WHEN x >= 0 THEN 1 ELSE 0 END::INT + CASE WHEN y >= 0 THEN 2 ELSE 0 END::INT AS drill_cluster, count(*) AS n FROM plane WHERE label = 3 GROUP BY 1")
def drilldown(spark, sf_dir):
    """One cluster split again, by quadrant of the map."""
    p = plane(spark, sf_dir).where("label = 3")
    return p.groupBy(((F.col("x") >= 0).cast("int") + (F.col("y") >= 0).cast("int") * 2).alias("drill_cluster")).agg(F.count("*").alias("n"))


@query("drilldown_map")
def drilldown_map(spark, sf_dir):
    """One cluster projected and clustered again; both are iterative, so there is no SQL for it."""
    return vectors.drill_down(embeddings(spark, sf_dir).where("label = 3"), "vec_id", "embedding", 4)


@query("portfolio_map")
def portfolio_map(spark, sf_dir):
    """The documents of one source projected and clustered anew, as a player's portfolio is."""
    d = table(spark, sf_dir, "documents")
    largest = d.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1)  # one row
    own = embeddings(spark, sf_dir).join(d.join(F.broadcast(largest), "source"), F.col("vec_id") == F.col("doc_id"))
    return vectors.drill_down(own, "vec_id", "embedding", 4)


POLYGON = [(-0.2, -0.1), (0.1, -0.15), (0.2, 0.1), (0.0, 0.05), (-0.1, 0.2)]
_EDGES = " + ".join(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]]))


@query("lasso", f"WITH {PLANE} SELECT vec_id, ({_EDGES}) % 2 = 1 AS picked FROM plane")
def lasso(spark, sf_dir):
    """Rows inside a drawn polygon."""
    return plane(spark, sf_dir).select("vec_id", vectors.inside(F.col("x"), F.col("y"), POLYGON).alias("picked"))


PART_YEARS = "w AS (SELECT unnest(string_split(p_name, ' ')) AS term, year(o_orderdate)::INT AS year FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT term, year, count(*) AS n FROM w GROUP BY 1, 2)"


@query("rising_terms", f"WITH {PART_YEARS} SELECT term, sum(n)::BIGINT AS n, round(regr_slope(n, year), 6) AS slope FROM c WHERE year < 2001 GROUP BY 1")
def rising_terms(spark, sf_dir):
    """Yearly slope of each word of the parts ordered, whole years only: the last one counts if orders reach its last day."""
    li, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    c = j.select(F.explode(F.split("p_name", " ")).alias("term"), F.year("o_orderdate").alias("year"))
    end = o.agg(F.year(F.date_add(F.max("o_orderdate"), 1)).alias("end"))  # one row
    c = c.join(F.broadcast(end)).where("year < end").groupBy("term", "year").agg(F.count("*").alias("n"))
    return growth.trends(c, "term").join(c.groupBy("term").agg(F.sum("n").alias("n")), "term").select("term", "n", F.round("slope", 6).alias("slope"))


@query("tornado", """WITH w AS (SELECT c_mktsegment AS s, unnest(string_split(p_name, ' ')) AS term FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT count(*) FILTER (s = 'BUILDING') AS a, count(*) FILTER (s = 'MACHINERY') AS b FROM w), g AS (SELECT term, count(*) FILTER (s = 'BUILDING') AS n_a, count(*) FILTER (s = 'MACHINERY') AS n_b FROM w GROUP BY 1)
SELECT term, n_a, n_b, round(n_a / a - n_b / b, 6) AS difference FROM g, t WHERE n_a + n_b > 0""")
def tornado(spark, sf_dir):
    """How the words that two market segments order differ in share."""
    li, p, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    pair = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(pair, o.o_custkey == pair.c_custkey)
    # A part's names are split once for each segment, not for each line.
    parts = j.groupBy("c_mktsegment", "p_name").agg(F.count("*").alias("n")).select("c_mktsegment", "n", F.explode(F.split("p_name", " ")).alias("term"))
    n = lambda s: F.sum(F.when(F.col("c_mktsegment") == s, F.col("n")).otherwise(0))
    g = parts.groupBy("term").agg(n("BUILDING").alias("n_a"), n("MACHINERY").alias("n_b"))
    total = parts.agg(n("BUILDING").alias("a"), n("MACHINERY").alias("b"))  # one row
    return g.join(F.broadcast(total)).select("term", "n_a", "n_b", F.round(F.col("n_a") / F.col("a") - F.col("n_b") / F.col("b"), 6).alias("difference"))


@query("cooccur_terms", f"""WITH d AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents),
v AS (SELECT term, count(*) AS df FROM d GROUP BY 1 ORDER BY df DESC, term LIMIT 50), k AS (SELECT doc_id, term, df FROM d JOIN v USING (term))
SELECT x.term AS a, y.term AS b, count(*) AS n, round(count(*) / (any_value(x.df) + any_value(y.df) - count(*)), 6) AS jaccard FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2""")
def cooccur_terms(spark, sf_dir):
    """How often the fifty most frequent terms share a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    v = d.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)  # the report's size
    e = network.co_occurrence(d.join(F.broadcast(v), "term"), "doc_id", "term")
    a, b = (v.select(F.col("term").alias(x), F.col("df").alias(f"df_{x}")) for x in "ab")
    return e.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", "n", F.round(F.col("n") / (F.col("df_a") + F.col("df_b") - F.col("n")), 6).alias("jaccard"))


EDGES = "s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2)"


def supplier_edges(spark, sf_dir):
    return network.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("coinventor_edges", f"WITH {EDGES} SELECT * FROM e")
def coinventor_edges(spark, sf_dir):
    """Suppliers that share orders."""
    return supplier_edges(spark, sf_dir)


@query("degree", f"WITH {EDGES} SELECT node, count(*) AS degree, sum(n)::BIGINT AS weighted FROM (SELECT a AS node, n FROM e UNION ALL SELECT b, n FROM e) GROUP BY 1")
def degree(spark, sf_dir):
    return network.degrees(supplier_edges(spark, sf_dir))


@query("components", f"""WITH RECURSIVE {EDGES}, k AS (SELECT a, b FROM e WHERE n >= (SELECT avg(n) FROM e) * 1.5), l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node, min(other) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    """Groups of suppliers joined by strong ties."""
    return network.communities(network.strong(supplier_edges(spark, sf_dir), 1.5))


@query("clustering", f"""WITH {EDGES}, k AS (SELECT a, b FROM e WHERE n >= (SELECT avg(n) FROM e) * 1.5),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM k UNION ALL SELECT b FROM k) GROUP BY 1),
t AS (SELECT unnest([x.a, x.b, y.b]) AS node FROM k x JOIN k y ON x.b = y.a JOIN k z ON z.a = x.a AND z.b = y.b), c AS (SELECT node, count(*) AS triangles FROM t GROUP BY 1)
SELECT node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN round(coalesce(triangles, 0) / (degree * (degree - 1) / 2), 6) ELSE 0.0 END AS coefficient FROM d LEFT JOIN c USING (node)""")
def clustering(spark, sf_dir):
    """How closely the neighbours of a supplier are tied to one another, by strong ties."""
    return network.clustering(network.strong(supplier_edges(spark, sf_dir), 1.5))


@query("betweenness")
def betweenness(spark, sf_dir):
    """Nations between others in trade: ties of over the mean number of lines; a graph of 25 nodes."""
    li, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).where("s_nationkey <> c_nationkey")
    e = j.groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    return network.betweenness(network.strong(e, 1.2))


@query("kwic", f"""WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), h AS (SELECT doc_id, ts, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS w FROM t)
SELECT doc_id, pos AS "at", array_to_string(ts[greatest(pos - 3, 0) + 1:pos], ' ') AS before, array_to_string(ts[pos + 2:pos + 4], ' ') AS after FROM h WHERE w = 'than'""")
def kwic(spark, sf_dir):
    return search.kwic(table(spark, sf_dir, "documents"), "doc_id", tokens(F.col("text")), "than")


def rule(name, sql, cond):
    q = rf"WITH t AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS s FROM documents) SELECT doc_id FROM t WHERE {sql}"

    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
        return d.where(cond(F.col("t"))).select("doc_id")

    query(name, q)(run)


_W = r"[^ ]+ "
rule("rule_and", "s LIKE '% the %' AND s LIKE '% with %' AND NOT s LIKE '% from %'", lambda t: search.has(t, "the") & search.has(t, "with") & ~search.has(t, "from"))
rule("rule_or", "s LIKE '% que %' OR s LIKE '% und %'", lambda t: search.has(t, "que") | search.has(t, "und"))
rule("rule_adj", rf"regexp_matches(s, ' the ({_W}){{0,1}}of ')", lambda t: search.adjacent(t, "the", "of", 2))
rule("rule_near", rf"regexp_matches(s, ' with ({_W}){{0,2}}from ') OR regexp_matches(s, ' from ({_W}){{0,2}}with ')", lambda t: search.near(t, "with", "from", 3))


def with_vectors(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


@query("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    """Ten topics of the embeddings by k-means; the algorithm is iterative, so there is no SQL for it."""
    e = with_vectors(spark, sf_dir)
    model = KMeans(k=10, seed=7, featuresCol="v", predictionCol="topic").fit(e)
    return model.transform(e).groupBy("topic", "label").agg(F.count("*").alias("n"))


@query("landscape_pca")
def landscape_pca(spark, sf_dir):
    """A map of the embeddings on their two main axes, each axis turned so that its sum is not negative."""
    e = with_vectors(spark, sf_dir)
    xy = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", "label", vector_to_array("p").alias("p"))
    xy = xy.select("vec_id", "label", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    turn = xy.agg(F.when(F.sum("x") < 0, -1).otherwise(1).alias("sx"), F.when(F.sum("y") < 0, -1).otherwise(1).alias("sy"))  # one row
    return xy.join(F.broadcast(turn)).select("vec_id", "label", F.round(F.col("x") * F.col("sx"), 6).alias("umap_x"), F.round(F.col("y") * F.col("sy"), 6).alias("umap_y"))
