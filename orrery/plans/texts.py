"""Queries on text normalisation, terms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordering import numbered
from ..operators import labels, reports, tfidf
from .catalog import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def texts(name, sql, expr):
    """Register a query that derives one column from documents.text."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", expr(F.col("text")).alias("value")))


texts("strip_punct", r"regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g')", tx.strip_punctuation)
texts("strip_parens", r"regexp_replace(text, '[(（][\p{L}\p{M}\p{N}_\s]+[)）]', ' ', 'g')", tx.strip_parenthesised)
texts("strip_figrefs", r"regexp_replace(text, '(^|[^\p{L}\p{M}\p{N}_])(図|fig|step|s)\s?\d+($|[^\p{L}\p{M}\p{N}_])', '\1 \3', 'g')", tx.strip_figure_references)
texts("trim_unicode", r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')", tx.trim_unicode)
texts("md_bold", r"regexp_replace(text, '\*\*(.*?)\*\*', '<b>\1</b>', 'g')", tx.bold_markup)


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS value FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("value"))


@query("text_concat", "SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(nullif(p_brand, 'Brand#11'), '') || ' ' || coalesce(p_type, '') AS value FROM part")
def text_concat(spark, sf_dir):
    missing = F.when(F.col("p_brand") != "Brand#11", F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.concat_fields(F.col("p_name"), missing, F.col("p_type")).alias("value"))


@query("text_nfkc")
def text_nfkc(spark, sf_dir):
    """NFKC and lower case; no SQL engine at hand has that form."""
    return docs(spark, sf_dir).select("doc_id", tx.nfkc_lower(F.col("text")).alias("value"))


def tagged(toks):
    """Tokens with a part of speech by a plain rule: words on -ed, -ing and -ly are no nouns."""
    return F.transform(toks, lambda t: F.struct(t.alias("base"), F.when(t.rlike("(ed|ing|ly)$"), "other").otherwise("noun").alias("pos")))


@query("noun_compound")
def noun_compound(spark, sf_dir):
    """Nouns and compounds of two of each document; a fold that SQL has no form for."""
    return docs(spark, sf_dir).select("doc_id", tx.noun_compounds(tagged(tx.tokens(F.col("text"))), ["the", "of", "and"]).alias("value"))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TFIDF = rf"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT count(*) AS docs FROM documents),
idf AS (SELECT term, ln((1 + docs)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), n WHERE df >= 5 AND df <= 0.8 * docs),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weights(spark, sf_dir):
    return tfidf.tfidf(docs(spark, sf_dir), "doc_id", tx.tokens(F.col("text")))


@query("token_counts", f"SELECT doc_id, len({TOKENS}) AS n, len(list_distinct({TOKENS})) AS distinct_n FROM documents")
def token_counts(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("distinct_n"))


@query("term_freq", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1")
def term_freq(spark, sf_dir):
    t = tfidf.term_counts(docs(spark, sf_dir), "doc_id", tx.tokens(F.col("text")))
    return t.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_query(spark, sf_dir):
    return weights(spark, sf_dir).select("doc_id", "term", F.round("weight", 6).alias("weight"))


KEYWORDS = """mean AS (SELECT lang, term, round(sum(weight) / any_value(size), 6) AS weight FROM tfidf JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS size FROM documents GROUP BY 1) USING (lang) GROUP BY 1, 2),
top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)::INT AS rank, term, weight FROM mean WHERE weight > 0)"""


def language_terms(spark, sf_dir, top=10):
    return tfidf.cluster_terms(weights(spark, sf_dir), docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang", top)


@query("cluster_keywords", f"WITH {TFIDF}, {KEYWORDS} SELECT * FROM top WHERE rank <= 10")
def cluster_keywords(spark, sf_dir):
    return language_terms(spark, sf_dir)


@query("auto_label", f"WITH {TFIDF}, {KEYWORDS} SELECT lang, string_agg(term, ', ' ORDER BY rank) AS label FROM top WHERE rank <= 3 GROUP BY 1")
def auto_label(spark, sf_dir):
    """A label for each language from its three heaviest terms."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return language_terms(spark, sf_dir, 3).groupBy("lang").agg(F.array_join(F.transform(rows, lambda r: r["term"]), ", ").alias("label"))


# The marks of reports, as in operators.reports.
REPORT = "'# Report ' || conv_id || chr(10) || chr(10) || text || chr(10) || '---' || chr(10) || '## Turn ' || turn || chr(10) || '- **' || role || '** said' || chr(10) || '#### Note' || chr(10) || '  See 、[[Evidence ' || turn + 1 || ']], and [[evidence 999]] too' || chr(10) || '　# Wide　' || chr(10) || 'one **b**,' || chr(10) || '[[Evidence 1]] 、 [[Evidence 2]], **c** '"


def reports_of(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = lambda x: F.col(x).cast("string")
    text = F.concat(F.lit("# Report "), s("conv_id"), F.lit("\n\n"), "text", F.lit("\n---\n## Turn "), s("turn"), F.lit("\n- **"), "role", F.lit("** said\n#### Note\n  See 、[[Evidence "), (F.col("turn") + 1).cast("string"), F.lit("]], and [[evidence 999]] too\n　# Wide　\none **b**,\n[[Evidence 1]] 、 [[Evidence 2]], **c** "))
    return c.select(F.concat_ws("-", s("conv_id"), s("turn")).alias("key"), text.alias("report"))


@query("md_blocks", rf"""WITH r AS (SELECT conv_id || '-' || turn AS key, string_split({REPORT}, chr(10)) AS ls FROM conversations),
l AS (SELECT key, unnest(range(len(ls)))::INT AS line_no, regexp_replace(unnest(ls), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS line FROM r),
k AS (SELECT *, CASE WHEN line = '' THEN 'spacer' WHEN regexp_matches(line, '^[-*_]{{3,}}$') THEN 'rule' WHEN regexp_matches(line, '(?i)\[\[Evidence (\d+)\]\]') THEN 'evidence' WHEN line LIKE '# %' THEN 'heading1' WHEN line LIKE '## %' THEN 'heading2' WHEN line LIKE '### %' THEN 'heading3' WHEN line LIKE '#### %' THEN 'strong' WHEN line LIKE '- %' OR line LIKE '* %' THEN 'bullet' ELSE 'normal' END AS kind FROM l)
SELECT key, line_no, kind, CASE kind WHEN 'strong' THEN '<b>' WHEN 'bullet' THEN '• ' ELSE '' END || regexp_replace(CASE WHEN kind IN ('heading1', 'heading2', 'heading3', 'strong', 'bullet') THEN regexp_replace(regexp_replace(line, '^(#+|[-*]) ', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') WHEN kind IN ('rule', 'spacer') THEN '' ELSE line END, '\*\*(.*?)\*\*', '<b>\1</b>', 'g') || CASE kind WHEN 'strong' THEN '</b>' ELSE '' END AS content,
  kind IN ('heading1', 'heading2') AND line_no > 0 AS page_break FROM k""")
def md_blocks(spark, sf_dir):
    return reports.blocks(reports_of(spark, sf_dir), "key", "report")


@query("evidence_refs", rf"""WITH r AS (SELECT conv_id || '-' || turn AS key, regexp_extract_all({REPORT}, '(?i)\[\[Evidence (\d+)\]\]', 1) AS ns FROM conversations),
e AS (SELECT key, unnest(range(len(ns)))::INT AS nth, unnest(ns)::BIGINT AS ordinal FROM r)
SELECT key, nth, ordinal, item_id AS id FROM e JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS ordinal FROM benchmark) USING (ordinal)""")
def evidence_refs(spark, sf_dir):
    """Benchmark items are the numbered evidence."""
    numbers = numbered(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "ordinal")
    return reports.evidence_refs(reports_of(spark, sf_dir), "key", "report", numbers)


@query("evidence_cleanup", rf"""WITH r AS (SELECT conv_id || '-' || turn AS key, string_split({REPORT}, chr(10)) AS ls FROM conversations),
l AS (SELECT key, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS raw FROM r),
s AS (SELECT key, line_no, regexp_split_to_array(regexp_replace(raw, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '(?i)\[\[Evidence \d+\]\]') AS ps FROM l WHERE regexp_matches(raw, '(?i)\[\[Evidence \d+\]\]')),
p AS (SELECT key, line_no, len(ps) AS n, unnest(range(len(ps)))::INT AS part_no, unnest(ps) AS t FROM s),
q AS (SELECT *, CASE WHEN part_no < n - 1 THEN regexp_replace(t, '[、, \t]+$', '') ELSE t END AS u FROM p),
v AS (SELECT key, line_no, part_no, regexp_replace(CASE WHEN part_no > 0 THEN regexp_replace(u, '^[、, \t]+', '') ELSE u END, '\*\*(.*?)\*\*', '<b>\1</b>', 'g') AS content FROM q)
SELECT * FROM v WHERE regexp_replace(content, '[\s\p{{Z}}]+', '', 'g') <> ''""")
def evidence_cleanup(spark, sf_dir):
    return reports.text_parts(reports_of(spark, sf_dir), "key", "report")


@query("evidence_append", """WITH b AS (SELECT item_id AS id, substring(text, 1, 40) AS title, substring(text, 41, 80) AS description FROM benchmark),
log AS (SELECT row_number() OVER (ORDER BY id) AS ordinal, * FROM b WHERE id % 3 = 0)
SELECT * FROM log UNION ALL SELECT row_number() OVER (ORDER BY id) + (SELECT count(*) FROM log), * FROM b WHERE id % 3 <> 0""")
def evidence_append(spark, sf_dir):
    """All items offered, twice, to a log that has every third already."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 80).alias("description"))
    log = numbered(items.where("id % 3 = 0"), "id", "ordinal")
    return reports.append_new(reports.append_new(log, items), items.union(items))


@query("evidence_names", "SELECT item_id AS id, 'Evidence ' || row_number() OVER (ORDER BY item_id) || '.png' AS name FROM benchmark")
def evidence_names(spark, sf_dir):
    numbers = numbered(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "ordinal")
    return numbers.select("id", reports.evidence_name(F.col("ordinal")).alias("name"))


@query("date_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(o_orderdate, '%B %d, %Y') AS day FROM orders")
def date_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.stamp(F.col("o_orderdate")).alias("stamp"), tx.long_date(F.col("o_orderdate")).alias("day"))


@query("json_labels", "SELECT event_id, (props->>'k') AS label FROM events WHERE props->>'k' IS NOT NULL")
def json_labels(spark, sf_dir):
    """The label that each event's JSON, fenced as pasted text is, has for its key."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", labels.parse(fenced)["k"].alias("label")).where("label is not null")
