"""Expected values worked out by hand from the rules."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import metadata
from orrery.functions import text as tx
from orrery.functions.dates import DateParser
from orrery.functions.ordering import numbered
from orrery.operators import growth, hooks, labels, network, reports, search, stopwords
from orrery.operators.schema import ColumnMap, match_column
from orrery.plans.catalog import query  # noqa: F401
from orrery.sources import readers


def value(spark, x, f, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("options, current, keywords, place", [
    ([None, "出願番号", "出願日", "出願人"], None, ("出願日", "Date"), 2),
    ([None, "Filing Date (orig)"], None, ("出願日", "Date"), 1),
    ([None, "Update", "Application Date"], None, ("Date",), 2),
    ([None, "A", "B"], "B", ("A",), 2),
    ([None, "A", "B"], None, ("Z",), 0),
])
def test_match_column(options, current, keywords, place):
    assert match_column(current, options, keywords) == place


def test_missing_roles(spark):
    m = ColumnMap.bind(["title", "abstract"])
    assert "ipc" in m.missing()
    with pytest.raises(ValueError):
        m.project(spark.range(1))


@pytest.mark.parametrize("x, codes, groups", [
    ("H01M 10/0525; H01M 4/36", ["h01m10/0525", "h01m4/36"], ["H01M 10", "H01M 4"]),
    ("H01M10/05(2010.01);G06F", ["h01m10/05", "g06f"], ["G06F", "H01M10"]),
    ("H01M 10/5", ["h01m"], ["H01M 10"]),
    ("H01M10/5", [], ["H01M10"]),
    ("H01M 10/05;H01M 10/05", ["h01m10/05"] * 2, ["H01M 10"]),
    ("Ｈ０１Ｍ　１０／０５２５", ["h01m10/0525"], ["Ｈ０１Ｍ　１０／０５２５"]),
    (None, [], []),
])
def test_classification(spark, x, codes, groups):
    assert value(spark, x, metadata.ipc_codes) == codes
    assert value(spark, x, metadata.ipc_main_groups) == groups


@pytest.mark.parametrize("f, x, want", [
    (metadata.fterm_themes, "5H029AJ12;5H029;5H0", ["5H029"]),
    (metadata.fterm_themes, "X1234; 5H0 ", ["5H0", "X1234"]),
    (metadata.name_list, "A社; B社 ;A社;", ["A社", "B社"]),
    (metadata.inventor_list, "▲高▼橋　一郎; ;高橋一郎", ["高橋一郎"]),
    (metadata.inventor_list, None, []),
])
def test_names(spark, f, x, want):
    assert value(spark, x, f) == want


def test_delimiter_is_literal(spark):
    assert value(spark, "a.b.c", lambda c: metadata.name_list(c, ".")) == ["a", "b", "c"]


@pytest.mark.parametrize("toks, want", [
    ([("電池", "noun"), ("材料", "noun"), ("開発", "noun")], "電池材料 開発"),
    ([("電池", "noun"), ("装置", "noun"), ("材料", "noun")], "電池 材料"),
    ([("電", "noun"), ("電池", "noun")], "電池"),
    ([("電池", "noun"), ("膜", "noun")], "電池膜"),
    ([("走る", "verb"), ("電池", "noun")], "電池"),
    ([], ""),
    ([("ab", "noun")] * 401, " ".join(["abab"] * 200 + ["ab"])),
])
def test_noun_compounds(spark, toks, want):
    assert value(spark, toks, lambda c: tx.noun_compounds(c, ["装置"]), "array<struct<base:string,pos:string>>") == want


@pytest.mark.parametrize("f, x, want", [
    (tx.nfkc_lower, "（Ａ１）℃㈱；X", unicodedata.normalize("NFKC", "（Ａ１）℃㈱；X").lower()),
    (tx.nfkc_lower, None, None),
    (tx.strip_parenthesised, "電池(図 1)と（説明）(a-b)", "電池 と (a-b)"),
    (tx.strip_figure_references, "see fig 12 and 図 3, step4", "see   and  ,  "),
    (tx.trim_unicode, "　あ い　\t", "あ い"),
    (tx.strip_punctuation, "a,b}~]c", "a b   c"),
    (lambda c: tx.strip_punctuation(c, True), "a,b}~]c", "a,b c"),
    (tx.flatten_snippet, "a\nb", "a b..."),
])
def test_text(spark, f, x, want):
    assert value(spark, x, f) == want


@pytest.mark.parametrize("xs, fmt, want", [
    (["20200115", "20210301", None], "yyyyMMdd", ["2020-01-15", "2021-03-01", None]),
    (["2019", "2020", "2021"], "yyyy", ["2019-01-01", "2020-01-01", "2021-01-01"]),
    (["44000", "43831", "x"], "serial", ["2020-06-18", "2020-01-01", None]),
    (["2020/1/5", "2020/11/15"], "yyyy/M/d", ["2020-01-05", "2020-11-15"]),
])
def test_dates(spark, xs, fmt, want):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    p = DateParser.fit(df, "x")
    assert p.format == fmt
    got = df.select("i", p.transform(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] and str(r["y"].date()) for r in got] == want


@pytest.mark.parametrize("counts, cagr, slope, trend", [
    ({2018: 2, 2020: 8}, 1.0, 3.0, "surge"),
    ({2018: 4, 2022: 5}, 0.057371, 0.25, "up"),
    ({2018: 10, 2022: 9}, -0.025996, -0.25, "down"),
    ({2019: 4, 2020: 4}, 0.0, 0.0, "down"),
    ({2018: 10, 2019: 8}, -0.2, -2.0, "stall"),
    ({2020: 5}, 0.0, 0.0, "stable"),
])
def test_trends(spark, counts, cagr, slope, trend):
    r = growth.trends(spark.createDataFrame([("k", y, n) for y, n in counts.items()], "k string, year int, n long"), "k").first()
    assert (round(r["cagr"], 6), round(r["slope"], 6), r["trend"]) == (cagr, slope, trend)


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 30))
def test_equal_shares(spark, n):
    r = growth.concentration(spark.range(n).select(F.lit("k").alias("k"), "id"), "id", "k").first()
    assert abs(r["hhi"] - 1 / n) < 1e-9
    assert r["hhi_status"] == ("competitive" if 1 / n < 0.1 else "moderate" if 1 / n < 0.18 else "concentrated")


def words(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "word string")


def test_stopword_edit(spark):
    cur = words(spark, "a", "b", "ab", "c")
    got = stopwords.edit(cur, stopwords.search(cur, "a"), words(spark, "a", "zz")).collect()
    assert {r["word"] for r in got if r["change"] != "removed"} == {"a", "b", "c", "zz"}
    assert {r["word"] for r in got if r["change"] == "removed"} == {"ab"}
    assert stopwords.search(words(spark, "x[y", "z"), "[").count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("```json\n{\"0\":\"a\",\"x\":\"b\",\"9\":\"c\"}\n```",), ("not json",)], "j string")
    got = labels.apply(spark.createDataFrame([(0,), (1,)], "c int"), "c", labels.entries(df, "j")).orderBy("c").collect()
    assert [r["label_text"] for r in got] == ["[0] a", None]


@pytest.mark.parametrize("line, kind", [("", "spacer"), ("---", "rule"), ("***", "rule"), ("--", "normal"), ("# T", "heading1"), ("## T", "heading2"), ("### T", "heading3"), ("#### T", "strong"), ("- x", "bullet"), ("* x", "bullet"), ("####x", "normal"), ("A [[evidence 3]]", "evidence")])
def test_report_lines(spark, line, kind):
    assert value(spark, line, reports.kind_of) == kind


def test_evidence(spark):
    df = spark.createDataFrame([("k", "A、[[Evidence 1]]、B [[evidence 3]]")], "k string, t string")
    ev = spark.createDataFrame([(1, "i1"), (2, "i2")], "ordinal long, id string")
    assert [(r["nth"], r["id"]) for r in reports.evidence_refs(df, "k", "t", ev).collect()] == [(0, "i1")]
    assert [r["content"] for r in reports.text_parts(df, "k", "t").orderBy("part_no").collect()] == ["A", "B"]


def test_positions(spark):
    t = lambda f: value(spark, ["a", "x", "b", "a"], f, "array<string>")
    assert t(lambda c: search.adjacent(c, "a", "b", 2)) and not t(lambda c: search.adjacent(c, "a", "b", 1))
    assert t(lambda c: search.near(c, "b", "a", 1)) and not t(lambda c: search.near(c, "a", "a", 1))


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (4, 5, 1)], "a long, b long, n long")
    assert {r["node"]: r["component"] for r in network.communities(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r["node"]: r["betweenness"] for r in network.betweenness(e).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_csv_charsets(spark, tmp_path):
    body = '題名,要約\n"電池ﾃｽﾄ","a ""b""\nc"\nNaN,x\n'
    for enc in ("utf-8", "shift_jis"):
        p = tmp_path / f"{enc}.csv"
        p.write_bytes(body.encode(enc))
        got = readers.read_table(spark, str(p)).collect()
        assert [tuple(r) for r in got] == [("電池ﾃｽﾄ", 'a "b"\nc'), (None, "x")]


def test_stream(spark, sf_dir, tmp_path):
    from orrery.streaming.ingest import counts_by_window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    q = counts_by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_roles_of_usual_headers():
    m = ColumnMap.bind(["No", "Title", "Abstract", "Claim", "Application Number", "Date", "Applicant", "IPC"])
    assert not m.missing() and m.roles["app_num"] == "Application Number" and m.roles["inventor"] is None
    m = ColumnMap.bind(["出願番号", "発明の名称", "要約", "請求項", "出願日", "出願人", "国際特許分類(IPC)", "f-term"])
    assert not m.missing() and m.roles["ipc"] == "国際特許分類(IPC)" and m.roles["fterm"] == "f-term"


@pytest.mark.parametrize("x, codes", [("H01M10(x)/05", []), ("H01M 10(x)/05", ["h01m"]), ("H01M10/05(2010.01)", ["h01m10/05"])])
def test_brackets_are_spaces(spark, x, codes):
    assert value(spark, x, metadata.ipc_codes) == codes


def test_nothing_to_measure(spark):
    none = spark.createDataFrame([], "k string, year int, n long, party string")
    assert tuple(growth.concentration(none, "party").first()) == (0.0, "no data")
    assert tuple(growth.trends(none).first()) == (None, None, None)


def test_evidence_is_cleaned_line_by_line(spark):
    df = spark.createDataFrame([("k", "one,\n[[Evidence 1]]\n 、[[evidence 2]] 、 x,[[Evidence 3]]")], "k string, t string")
    assert [(r["line_no"], r["content"]) for r in reports.text_parts(df, "k", "t").collect()] == [(2, "x")]


def test_lines_are_trimmed_of_any_space(spark):
    df = spark.createDataFrame([("k", "　# T　\n#### S **b**\n* x")], "k string, t string")
    got = [(r["kind"], r["content"]) for r in reports.blocks(df, "k", "t").orderBy("line_no").collect()]
    assert got == [("heading1", "T"), ("strong", "<b>S <b>b</b></b>"), ("bullet", "• x")]


def test_log_is_numbered_on(spark):
    log = spark.createDataFrame([(1, "b", "B", "m")], "ordinal long, id string, title string, module string")
    new = spark.createDataFrame([("b", "other", "m"), ("c", "C", "m"), ("a", "A", "m"), ("a", "A", "m")], "id string, title string, module string").withColumn("n", F.ascii("id"))
    # Ids that are numbers give the order; any others are mapped to one first.
    fresh = new.drop("id").withColumnRenamed("n", "id")
    out = reports.append_new(log.withColumn("id", F.ascii("id")), fresh)
    want = [(1, 98, "B", "m"), (2, 97, "A", "m"), (3, 99, "C", "m")]
    assert [tuple(r) for r in out.orderBy("ordinal").collect()] == want
    assert [tuple(r) for r in reports.append_new(out, fresh).orderBy("ordinal").collect()] == want


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_numbered(spark, parts):
    df = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "id long")
    assert all(r["id"] + 1 == r["n"] for r in numbered(df, "id", "n", parts).collect())
    assert numbered(df.limit(0), "id", "n", parts).count() == 0


def test_hooks(spark):
    df = spark.createDataFrame([(k, "a" * k if k else None) for k in range(300)], "k int, t string")
    got = hooks.encode(df, "t", lambda texts: [[len(t), len(texts)] for t in texts], batch=16).collect()
    assert all(r["embedding"][0] == r["k"] and r["embedding"][1] <= 16 for r in got) and len(got) == 300
    toks = hooks.tag(df.where("k < 3"), "t", lambda texts: [[(t, "noun")] * 2 for t in texts])
    assert toks.select(tx.noun_compounds(F.col("tokens"), []).alias("c")).where("c = 'aaaa'").count() == 1


def test_files_are_decoded_each_for_itself(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,電池\n".encode("shift_jis"))
    (tmp_path / "b.csv").write_bytes("k,v\n2,材料é\n3,\n".encode())
    got = {r["k"]: r["v"] for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": "電池", "2": "材料é", "3": None}


def test_drill_down_keeps_rows_and_axes(spark):
    from orrery.operators import vectors

    rows = [(k, [float(k % 5) * 10, float(k), 0.0]) for k in range(60)]
    got = vectors.drill_down(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 3).collect()
    assert sorted(r["k"] for r in got) == list(range(60)) and {r["drill_cluster"] for r in got} == {0, 1, 2}
    # The main axes keep the distances of points that lie in a plane.
    at = {r["k"]: (r["drill_x"], r["drill_y"]) for r in got}
    assert all(abs(sum((a - b) ** 2 for a, b in zip(at[i], at[j])) - sum((a - b) ** 2 for a, b in zip(rows[i][1], rows[j][1]))) < 1e-2 for i, j in ((0, 1), (3, 58), (20, 41)))


def test_stopword_list_is_reset(spark):
    w = spark.createDataFrame([("the",), ("zz",)], "word string")
    got = {r["word"]: r["change"] for r in stopwords.reset(w).collect()}
    assert got["zz"] == "removed" and got["the"] == "kept" and sum(c == "added" for c in got.values()) == len(stopwords.DEFAULTS) - 1
