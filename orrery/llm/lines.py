"""Line deduplication by overlapping three-line windows.

A window is three consecutive lines of one document that are not blank;
lines are compared without the white space around them. Of the equal windows
of the whole corpus the first (smallest id, then position) stays, and every
line that a later one covers is removed. Windows are judged on the input.

Edge cases: a null text counts as empty; fewer than three lines that aren't
blank make no window, so nothing goes; blank lines stay; rows that share an
id count as one place, so equal windows at one position of such rows both
stay; rows with a null id share the last place, after all others; a row loses
only lines that its own windows cover, whatever its id; an empty table gives
an empty table. Only the named columns are read, so further columns can't
clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, table, text_key, unused

TRIM = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"
LAST = (1 << 63) - 1


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _shown(lines):
    """(position, trimmed) of the lines that aren't blank."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, TRIM, "").alias("line")))
    return F.filter(at, lambda x: x["line"] != "")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, text_key, a, b, first, lines): two hashes of each window, its number, and the lines that it covers."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_key(F.col(text_col).cast("string")).alias("text_key"), _shown(_lines(F.col(text_col).cast("string"))).alias("s"))
    src = src.where(F.size("s") >= size)
    # Each line is hashed once; a window's hashes are made from those of its lines.
    src = src.select("id", "text_key", F.transform("s", lambda x: x["at"]).alias("at"), F.transform("s", lambda x: F.xxhash64(x["line"])).alias("h"), F.transform("s", lambda x: F.xxhash64(F.lit("2"), x["line"])).alias("g"))
    start = F.sequence(F.lit(0), F.size("h") - size)
    window = F.transform(start, lambda i: F.struct(F.xxhash64(*[F.get("h", i + k) for k in range(size)]).alias("a"), F.xxhash64(*[F.get("g", i + k) for k in range(size)]).alias("b"), F.transform(F.sequence(i, i + size - 1), lambda j: F.get("at", j)).alias("lines")))
    return src.select("id", "text_key", F.posexplode(window).alias("first", "w")).select("id", "text_key", "first", "w.a", "w.b", "w.lines")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, text_key, gone): the positions of lines to remove, for documents that lose any."""
    w = store(windows(docs, id_col, text_col, size), "windows")
    # Stored, so that a common window's rows can be split when they meet its one row.
    first = store(w.groupBy("a", "b").agg(F.min(F.struct("id", "first")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("a", "b", "kept"), "first")
    later = w.join(first, ["a", "b"]).where(F.struct("id", "first") > F.col("kept"))
    return store(later.select("id", "text_key", F.explode("lines").alias("at")).groupBy("id", "text_key").agg(F.collect_set("at").alias("gone")), "gone")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text after removal, and n_lines, n_removed (with an underscore where ``docs`` has such columns)."""
    key, own, out, n_lines, n_removed = unused(docs, "line_id", "line_key", "lines_gone", "n_lines", "n_removed")
    gone = repeated_lines(docs, id_col, text_col, size).select(F.col("id").alias(key), F.col("text_key").alias(own), F.col("gone").alias(out))
    lines = _lines(F.col(text_col).cast("string"))
    # Merged whatever the size: the texts are shuffled once, and what a small input shows of the disk holds for a large one.
    joined = docs.join(gone.hint("merge"), (F.coalesce(docs[id_col].cast("long"), F.lit(LAST)) == gone[key]) & (text_key(docs[text_col].cast("string")) == gone[own]), "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out, i)), "\n")
    made = {n_lines: F.size(lines).cast("long"), n_removed: F.coalesce(F.size(out), F.lit(0)).cast("long"), text_col: F.when(F.col(out).isNull(), F.col(text_col)).otherwise(kept)}
    return joined.withColumns(made).drop(key, own, out)


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL9 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
shown AS (
  SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines),
numbered AS (
  SELECT *, row_number() OVER d AS k, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(pos, 1) OVER d AS a2, lead(pos, 2) OVER d AS a3
  FROM shown WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, k) AS nth FROM numbered WHERE l3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, a2, a3]) AS pos FROM later WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY 1
"""
