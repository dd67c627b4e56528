"""Queries on schema binding, multi-valued fields, dates and stopwords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..functions.dates import DateParser
from ..functions.text import flatten_snippet, shorten
from ..operators import growth, schema, stopwords
from .catalog import query, table

SPLIT = "list_filter(list_transform(string_split({x}, ';'), lambda p: trim(p)), lambda p: p <> '')"
# Code strings of each part, such as "B01A 12/345; b02c(x);Brand#12".
CODES = "'H' || lpad((p_size % 60)::VARCHAR, 2, '0') || 'M ' || p_partkey % 100 || '/' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '(2010.01); g' || lpad((p_size % 100)::VARCHAR, 2, '0') || 'f ;' || p_brand || '/' || p_type || ';; ' || p_brand || ';G06F1(x)/10 ; G06F1 (x) 7/10'"


def parts_with_codes(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    number = (F.col("p_partkey") % 90 + 10).cast("string")
    codes = F.concat(F.lit("H"), two(F.col("p_size") % 60), F.lit("M "), (F.col("p_partkey") % 100).cast("string"), F.lit("/"), number, F.lit("(2010.01); g"), two(F.col("p_size") % 100), F.lit("f ;"), "p_brand", F.lit("/"), "p_type", F.lit(";; "), "p_brand", F.lit(";G06F1(x)/10 ; G06F1 (x) 7/10"))
    return table(spark, sf_dir, "part").select("p_partkey", codes.alias("codes"))


@query("ipc_main_group", f"""WITH c AS (SELECT p_partkey, {CODES} AS codes FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(codes, ';'), lambda p: upper(trim(string_split(trim(p), '/')[1]))), lambda p: p <> ''))), '|') AS groups FROM c""")
def ipc_main_group(spark, sf_dir):
    return parts_with_codes(spark, sf_dir).select("p_partkey", F.array_join(metadata.ipc_main_groups(F.col("codes")), "|").alias("groups"))


@query("ipc_normalize", rf"""WITH c AS (SELECT p_partkey, unnest(string_split(regexp_replace(lower({CODES}), '\([^)]*\)', ' ', 'g'), ';')) AS p, generate_subscripts(string_split({CODES}, ';'), 1) AS i FROM part),
k AS (SELECT p_partkey, i, CASE WHEN regexp_matches(p, '[a-z]\d\d[a-z]\s*\d{{1,4}}/\d\d+') THEN regexp_extract(p, '([a-z]\d\d[a-z])\s*(\d{{1,4}}/\d\d+)', 1) || regexp_extract(p, '([a-z]\d\d[a-z])\s*(\d{{1,4}}/\d\d+)', 2)
  WHEN regexp_matches(p, '\b[a-z]\d\d[a-z]\b') THEN regexp_extract(p, '\b([a-z]\d\d[a-z])\b', 1) END AS code FROM c)
SELECT p_partkey, coalesce(string_agg(code, '|' ORDER BY i), '') AS codes FROM k GROUP BY 1""")
def ipc_normalize(spark, sf_dir):
    return parts_with_codes(spark, sf_dir).select("p_partkey", F.array_join(metadata.ipc_codes(F.col("codes")), "|").alias("codes"))


@query("fterm_theme", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(p_type || '; ' || p_brand || ';ab', ';'), lambda p: trim(p) <> '' AND length(p) >= 5), lambda p: upper(substring(trim(p), 1, 5))))), '|') AS themes FROM part""")
def fterm_theme(spark, sf_dir):
    c = F.concat("p_type", F.lit("; "), "p_brand", F.lit(";ab"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(metadata.fterm_themes(c), "|").alias("themes"))


SUPPLIERS = "SELECT l_orderkey, string_agg('s' || l_suppkey, '; ' ORDER BY l_linenumber) || ' ;' AS names FROM lineitem GROUP BY 1"


def order_suppliers(spark, sf_dir):
    """An order's suppliers as a delimited field."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.array_join(F.transform(rows, lambda x: x["s"]), "; "), F.lit(" ;")).alias("names"))


@query("applicant_list", f"WITH c AS ({SUPPLIERS}) SELECT l_orderkey, array_to_string(list_sort(list_distinct({SPLIT.format(x='names')})), '|') AS names FROM c")
def applicant_list(spark, sf_dir):
    return order_suppliers(spark, sf_dir).select("l_orderkey", F.array_join(metadata.name_list(F.col("names")), "|").alias("names"))


@query("applicant_counts", f"WITH c AS ({SUPPLIERS}), u AS (SELECT unnest(list_distinct({SPLIT.format(x='names')})) AS value FROM c) SELECT value, count(*) AS n FROM u GROUP BY 1")
def applicant_counts(spark, sf_dir):
    """Orders of each supplier, one count for each of an order's suppliers."""
    return growth.count_values(order_suppliers(spark, sf_dir).select(metadata.name_list(F.col("names")).alias("names")), "names")


@query("inventor_list", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(translate('▲' || c_name || '　;' || c_mktsegment || '▼; ;' || c_name, '▲▼　', ''), ';'), lambda p: trim(p)), lambda p: p <> ''))), '|') AS names FROM customer")
def inventor_list(spark, sf_dir):
    c = F.concat(F.lit("▲"), "c_name", F.lit("　;"), "c_mktsegment", F.lit("▼; ;"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(metadata.inventor_list(c), "|").alias("names"))


@query("date_vote", """SELECT o_orderkey, 'yyyyMMdd' AS a_format, 'serial' AS b_format, 'yyyy' AS c_format, o_orderdate::DATE::TIMESTAMP AS a, o_orderdate::DATE::TIMESTAMP AS b, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS c FROM orders""")
def date_vote(spark, sf_dir):
    """Three renderings of the order date, each read back by its column's vote."""
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string").alias("b"), F.date_format("o_orderdate", "yyyy").alias("c"))
    fits = DateParser.fit_all(o, list("abc"))
    return o.select("o_orderkey", *[F.lit(p.format).alias(f"{c}_format") for c, p in fits.items()], *[p.transform(F.col(c)).alias(c) for c, p in fits.items()])


PART_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part"


def part_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("stopword_search", f"WITH w AS ({PART_WORDS}) SELECT word FROM w WHERE regexp_matches(word, '^[a-m].*e')")
def stopword_search(spark, sf_dir):
    return stopwords.search(part_words(spark, sf_dir), "^[a-m].*e")


@query("stopword_expand", f"WITH w AS ({PART_WORDS}) SELECT word FROM w UNION SELECT translate(word, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ') FROM w WHERE regexp_matches(word, '[A-Za-z0-9]')")
def stopword_expand(spark, sf_dir):
    return stopwords.expand_width(part_words(spark, sf_dir))


@query("stopword_edit", f"""WITH w AS ({PART_WORDS}), m AS (SELECT word FROM w WHERE contains(word, 'a')), e AS (SELECT word FROM m WHERE length(word) > 5 UNION SELECT 'x' || n_name FROM nation),
removed AS (SELECT word FROM m EXCEPT SELECT word FROM e), added AS (SELECT word FROM e EXCEPT SELECT word FROM m)
SELECT word, 'kept' AS change FROM (SELECT word FROM w EXCEPT SELECT word FROM removed EXCEPT SELECT word FROM added) UNION ALL SELECT word, 'added' FROM added UNION ALL SELECT word, 'removed' FROM removed""")
def stopword_edit(spark, sf_dir):
    """The matches of "a", edited: short ones deleted and nations' names put in."""
    w = part_words(spark, sf_dir)
    m = stopwords.search(w, "a")
    e = m.where(F.length("word") > 5).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), "n_name").alias("word")))
    return stopwords.edit(w, m, e)


EDIT_COUNTS = f"""WITH w AS ({PART_WORDS}), i AS (SELECT DISTINCT trim(n_name) AS word FROM nation UNION SELECT word FROM w WHERE contains(word, 'e'))"""


@query("stopword_import", f"""{EDIT_COUNTS} SELECT word, 'kept' AS change FROM w UNION ALL SELECT word, 'added' FROM i WHERE word NOT IN (SELECT word FROM w)""")
def stopword_import(spark, sf_dir):
    """A file of nations' names, and of words that the list has, put into the list."""
    w = part_words(spark, sf_dir)
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("value")).union(w.where(F.contains("word", F.lit("e"))))
    return stopwords.imported(w, lines)


@query("stopword_replace", f"""{EDIT_COUNTS} SELECT (SELECT count(*) FROM i WHERE word NOT IN (SELECT word FROM w)) AS added, (SELECT count(*) FROM w WHERE word NOT IN (SELECT word FROM i)) AS removed, (SELECT count(*) FROM i) AS total""")
def stopword_replace(spark, sf_dir):
    """The counts of words added, removed and kept where another list takes the list's place."""
    w = part_words(spark, sf_dir)
    other = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).union(w.where(F.contains("word", F.lit("e")))).distinct()
    return stopwords.counts(stopwords.replace(w, other))


PROFILES = " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS filled, count(DISTINCT {c}) AS distinct_n FROM {t}" for t, cs in (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("nation", ("n_nationkey", "n_name", "n_regionkey"))) for c in cs)


@query("schema_match", f"""WITH k(role, keyword, kw_pos) AS (VALUES ('name', 'c_name', 0), ('name', 'name', 1), ('segment', 'segment', 0), ('balance', 'bal', 0), ('none', 'zz', 0)),
c AS (SELECT column_name AS col, column_index AS col_pos FROM duckdb_columns() WHERE table_name = 'customer' OR table_name = 'nation'), u AS (SELECT DISTINCT col, min(col_pos) AS col_pos FROM c GROUP BY col),
r AS (SELECT role, col, row_number() OVER (PARTITION BY role ORDER BY (col <> keyword), kw_pos, col_pos, col) AS nth FROM u JOIN k ON contains(col, keyword)),
p AS ({PROFILES})
SELECT role, r.col AS "column", filled, distinct_n FROM r JOIN p USING (col) WHERE nth = 1""")
def schema_match(spark, sf_dir):
    """Roles bound to the customer and nation tables' columns, and how many values and distinct values the columns have."""
    tables = [table(spark, sf_dir, t) for t in ("customer", "nation")]
    places = {}
    for df in tables:
        for i, c in enumerate(df.columns):
            places[c] = min(i, places.get(c, i))
    k = spark.createDataFrame([("name", "c_name", 0), ("name", "name", 1), ("segment", "segment", 0), ("balance", "bal", 0), ("none", "zz", 0)], "role string, keyword string, kw_pos int")
    found = schema.rank_matches(k, spark.createDataFrame(list(places.items()), "column string, col_pos int"))
    bound = {r["column"] for r in found.collect()}  # as many as there are roles
    profiles = [schema.profile(df, [c for c in df.columns if c in bound]) for df in tables if bound & set(df.columns)]
    out = profiles[0]
    for x in profiles[1:]:
        out = out.union(x)
    return found.join(out, "column").select("role", "column", "filled", "distinct_n")


@query("role_projection", "SELECT c_name AS title, c_mktsegment AS abstract, c_name AS claim, c_custkey AS app_num, c_acctbal AS date, c_name AS applicant, c_mktsegment AS ipc FROM customer")
def role_projection(spark, sf_dir):
    chosen = dict(title="c_name", abstract="c_mktsegment", claim="c_name", app_num="c_custkey", date="c_acctbal", applicant="c_name", ipc="c_mktsegment")
    c = table(spark, sf_dir, "customer")
    return schema.ColumnMap.bind(c.columns, {}, chosen).project(c)


@query("snippet", "SELECT doc_id, substring(translate(text, chr(10), ' '), 1, 200) || '...' AS snippet, CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END AS short FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", flatten_snippet(F.col("text")).alias("snippet"), shorten(F.col("text")).alias("short"))


@query("enriched_orders", """SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderkey::VARCHAR AS app_num_main, upper(trim(o_orderpriority)) AS ipc_main_group, o_orderstatus AS applicant_main, 0::INT AS inventors FROM orders""")
def enriched_orders(spark, sf_dir):
    """The whole enrichment of a table with headers of its own, orders as applications."""
    from ..operators.enrich import enrich

    o = table(spark, sf_dir, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("Key"), F.date_format("o_orderdate", "yyyy/M/d").alias("Filed"), "o_orderpriority", "o_orderstatus")
    chosen = dict(title="o_orderpriority", abstract="o_orderstatus", claim="o_orderpriority", app_num="Key", date="Filed", applicant="o_orderstatus", ipc="o_orderpriority")
    out = enrich(raw, schema.ColumnMap.bind(raw.columns, {}, chosen))
    first = lambda c: F.array_join(c, "|")
    return out.select(F.col("Key").cast("long").alias("o_orderkey"), "year", "app_num_main", first("ipc_main_group").alias("ipc_main_group"), first("applicant_main").alias("applicant_main"), F.size("inventor_main").alias("inventors"))
