"""Tool calls of conversations: linked, ordered, validated and serialised.

Calls and results meet in a hash join on conversation and call id. Calls are
ordered topologically: a call's round is the length of the longest chain of
dependencies behind it. Where all dependencies point to earlier turns the
order of turns is one, and every round is 0; any other conversation is ordered
in one task, or in distributed rounds where it has very many calls. Arguments
are checked against the tool's schema, and a call with its result is written
as canonical JSON: sorted keys, no spaces, characters as they are.

Edge cases: of several calls (or results) with one id in a conversation the
first by turn, then content, counts and the others are "duplicate" (results:
ignored); a call without a result is "pending", a result without a call is
ignored; a null id or conversation is "unlinked"; calls on a cycle or after
one are "cyclic" and come last, by turn; a dependency on an unknown call is
ignored; arguments that are no JSON object, or hold numbers that JSON can't,
are invalid and serialised as null; a lone surrogate is written as its escape;
an empty table gives an empty table. Columns besides those named are ignored.
A schema with a keyword that isn't checked here is an error at once.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import last_before, range_bucket, running_total, shuffle_partitions, split_points, store, table

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


#: Keywords that are checked, and those that only describe.
CHECKED = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "allOf"}
DESCRIBING = {"title", "description", "default", "examples", "$schema", "$id", "format"}
#: Calls of a conversation that one task orders; beyond it conversations are ordered in rounds.
MAX_CALLS = 100_000


def uncheckable(schema, at: str = "$") -> list[str]:
    """Keywords of a schema that ``problems`` would pass over, with their places."""
    if isinstance(schema, bool):
        return []
    out = [f"{at}: {k}" for k in schema if k not in CHECKED | DESCRIBING]
    inner = [(f"{at}.{k}", v) for k, v in schema.get("properties", {}).items()] + [(f"{at}[{k}]", v) for k in ("anyOf", "allOf") for v in schema.get(k, [])]
    inner += [(f"{at}[{k}]", schema[k]) for k in ("items", "additionalProperties") if isinstance(schema.get(k), dict)]
    return out + [x for place, v in inner for x in uncheckable(v, place)]


def is_type(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer":
        return isinstance(value, int) or isinstance(value, float) and value.is_integer()
    return isinstance(value, TYPES[kind])


def same(a, b) -> bool:
    """Equal as JSON: 1 is 1.0, but not true."""
    return canonical(a) == canonical(b) or not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and a == b


def problems(value, schema, at: str = "$") -> list[str]:
    """What is wrong with a JSON value under a schema."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_type(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{at}: out of bounds")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length out of bounds")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: not of the pattern")
    if isinstance(value, dict):
        own, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in own or isinstance(other, dict):
                out += problems(value[k], own.get(k, other), f"{at}.{k}")
            elif other is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items out of bounds")
        out += [p for i, v in enumerate(value) for p in problems(v, schema.get("items", True), f"{at}[{i}]")]
    if "anyOf" in schema and all(problems(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: none of the forms")
    return out + [p for s in schema.get("allOf", []) for p in problems(value, s, at)]


def written(text: str) -> str:
    """Lone surrogates, which no encoding has, as their escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def check(call_id, name, arguments, result, schemas: dict):
    """(problems, canonical JSON) of one call."""
    try:
        args = json.loads(arguments) if arguments is not None else None
        canonical(args)
        wrong = ["$: not a JSON object"] if not isinstance(args, dict) else [f"unknown tool {name}"] if name not in schemas else problems(args, schemas[name])
    except (ValueError, RecursionError):
        args, wrong = None, ["$: not a JSON object"]
    return [written(w) for w in wrong], canonical({"arguments": args if isinstance(args, dict) else None, "id": call_id, "name": name, "result": result})


def rounds(calls: list[str], deps: list[list[str]]) -> list[int | None]:
    """The round of each call, null on or after a cycle."""
    waits, follow, out = {c: len(d) for c, d in zip(calls, deps)}, {}, {}
    for c, d in zip(calls, deps):
        for x in d:
            follow.setdefault(x, []).append(c)
    ready, turn = [c for c in calls if not waits[c]], 0
    while ready:
        after = []
        for c in ready:
            out[c] = turn
            for x in follow.get(c, ()):
                waits[x] -= 1
                if not waits[x]:
                    after.append(x)
        ready, turn = after, turn + 1
    return [out.get(c) for c in calls]


def _in_rounds(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, round) by joining the open dependencies with the calls placed last, round by round."""
    out, turn = None, 0
    while True:
        ready = store(open_.join(edges, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(turn).alias("round")), "ready")
        if ready.isEmpty():
            rest = open_.withColumn("round", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        out = ready if out is None else out.unionByName(ready)
        # Every hundredth table of the union is written as one, which keeps the plan short.
        out = store(out, "placed") if turn % 100 == 99 else out
        done = ready.select("conv_id", "call_id")
        open_ = store(open_.join(done, ["conv_id", "call_id"], "left_anti"), "open")
        edges = store(edges.join(done.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_anti").select("conv_id", "call_id", "dep"), "edges")
        turn += 1


def order(calls: DataFrame, most: int = MAX_CALLS) -> DataFrame:
    """(conv_id, call_id, round): the round in which a call is placed.

    ``calls`` has unique (conv_id, call_id), turn and depends_on. Round 0 is
    for all calls of conversations whose dependencies precede them; null is
    for calls on or after a cycle.
    """
    deps = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("dep"))
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    deps = store(deps.join(known, ["conv_id", "dep"]), "dependencies")
    odd = store(deps.where("not coalesce(dep_turn < turn, false)").select("conv_id").distinct(), "unordered")
    out = calls.join(odd, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("round"))
    if odd.isEmpty():
        return out
    open_ = store(calls.join(odd, "conv_id", "left_semi").select("conv_id", "call_id"), "open")
    edges = store(deps.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "dep").distinct(), "edges")
    sizes = store(open_.withColumn("n", F.lit(1)).unionByName(edges.select("conv_id", "call_id", F.lit(1).alias("n"))).groupBy("conv_id").agg(F.sum("n").alias("n")), "sizes")
    few, many = sizes.where(F.col("n") <= most).select("conv_id"), store(sizes.where(F.col("n") > most).select("conv_id"), "many")
    if not many.isEmpty():
        out = out.unionByName(_in_rounds(store(open_.join(many, "conv_id", "left_semi"), "open"), store(edges.join(many, "conv_id", "left_semi"), "edges")))
    own = edges.groupBy("conv_id", "call_id").agg(F.collect_list("dep").alias("deps"))
    own = open_.join(few, "conv_id", "left_semi").join(own, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "deps"))).alias("calls"))

    def run(batches):
        for b in batches:
            for conv, rows in zip(b.column(0), b.column(1)):
                names = [x["call_id"] for x in rows.as_py()]
                placed = rounds(names, [x["deps"] for x in rows.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(names), conv.type), pa.array(names, pa.string()), pa.array(placed, pa.int32())], ["conv_id", "call_id", "round"])

    return out.unionByName(whole.mapInArrow(run, f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, round int"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: conv_id, call_id, turn, position, status, valid, problems, canonical.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON), depends_on
    (array of call ids); ``results``: conv_id, turn, call_id, content.
    """
    gaps = [x for name, schema in schemas.items() for x in uncheckable(schema, name)]
    if gaps:
        raise ValueError(f"schema keywords that aren't checked: {', '.join(gaps)}")
    rows = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "calls")
    known = rows.where("conv_id is not null and call_id is not null")
    # Grouped minima, so that many calls or results of one id meet only after they are reduced.
    first = store(known.groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").isNull(), "turn", "name", "arguments", "row")).alias("f")).select(F.col("f.row").alias("row"), F.lit(True).alias("is_first")), "first")
    rows = store(rows.join(first, "row", "left"), "calls")
    once = rows.where("is_first").drop("is_first")
    got = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").isNull(), "turn", "content")).alias("r"), F.lit(True).alias("has"))
    linked = once.join(got.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(order(once), ["conv_id", "call_id"])
    linked = linked.withColumn("status", F.when(F.col("round").isNull(), "cyclic").when(F.col("has"), "linked").otherwise("pending"))
    rest = rows.where("is_first is null").withColumn("status", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unlinked").otherwise("duplicate"))
    cols = ["conv_id", "call_id", "turn", "name", "arguments", "status"]
    # Positions by prefix sums over ranges of turns, so that a very long conversation isn't one task's.
    points = split_points(once.where("turn is not null"), "turn", shuffle_partitions(calls.sparkSession))
    last = (1 << 31) - 1
    bucket = F.struct(F.coalesce("round", F.lit(last)).alias("round"), F.when(F.col("turn").isNull(), last).otherwise(range_bucket(F.col("turn"), points)).alias("range"))
    linked = store(linked.select(*cols, F.col("r.content").alias("content"), bucket.alias("bucket"), F.lit(1).alias("one")), "linked")
    linked = running_total(linked, ["conv_id"], "bucket", [F.col("turn").asc_nulls_last(), "call_id"], "one", "position")
    every = linked.select(*cols, F.col("position").cast("long").alias("position"), "content").unionByName(rest.select(*cols, F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("content")))
    kept = every.select(F.col("conv_id").cast("string").alias("conv_id"), "call_id", F.col("turn").cast("long").alias("turn"), "position", "status", "name", "arguments", "content")

    def run(batches):
        for b in batches:
            made = [check(*x, schemas) for x in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content")))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array([not w for w, _ in made], pa.bool_()), pa.array(["; ".join(w) for w, _ in made], pa.string()), pa.array([c for _, c in made], pa.string())], ["conv_id", "call_id", "turn", "position", "status", "valid", "problems", "canonical"])

    return kept.mapInArrow(run, "conv_id string, call_id string, turn long, position long, status string, valid boolean, problems string, canonical string")


#: Tools that the turns of plain conversations are read as.
TURN_TOOLS = {
    "ask": {"type": "object", "required": ["question", "turn"], "additionalProperties": False, "properties": {"question": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}}},
}


def turns_as_calls(conversations: DataFrame):
    """(calls, results): user turns ask, system turns configure, assistant turns answer the call before them.

    A call depends on the one before it, found over ranges of turns; rows of
    one turn are in the order of role and text. A call without a conversation
    or a turn has no id, so that it stays unlinked, and neither it nor an
    answer without one has a call before it; a null role reads as an answer.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    asks = F.coalesce(F.col("role") != "assistant", F.lit(False))
    own = F.when(asks, F.concat(F.lit("call-"), "conv_id", F.lit("-"), "turn"))
    points = split_points(c.where("turn is not null"), "turn", shuffle_partitions(conversations.sparkSession))
    c = store(c.select("*", own.alias("own"), asks.alias("asks"), range_bucket(F.col("turn"), points).alias("range")), "turns")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    last = last_before(c.where(placed), ["conv_id"], "range", ["turn", "role", "text"], "own", "last")
    c = store(last.unionByName(c.where(~placed).withColumn("last", F.lit(None).cast("string"))), "turns")
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(F.col("text").alias("question"), "turn")))
    calls = c.where("asks").select("conv_id", "turn", F.col("own").alias("call_id"), F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"), arguments.alias("arguments"), F.when(F.col("last").isNotNull(), F.array("last")).alias("depends_on"))
    results = c.where("not asks").select("conv_id", "turn", F.col("last").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2(spark, sf_dir):
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    return link(calls, results, TURN_TOOLS)


SQL2 = r"""
WITH c AS (SELECT *, coalesce(text, '') AS t, CASE WHEN role <> 'assistant' THEN 'call-' || conv_id || '-' || turn END AS own FROM conversations),
w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
r AS (SELECT conv_id, prev AS own, arg_min(t, turn) AS content FROM w WHERE own IS NULL AND prev IS NOT NULL GROUP BY 1, 2),
j AS (SELECT w.*, r.content FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.own = w.own WHERE w.own IS NOT NULL)
SELECT conv_id::VARCHAR AS conv_id, own AS call_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  CASE WHEN content IS NULL THEN 'pending' ELSE 'linked' END AS status,
  role = 'system' OR length(t) >= 20 AS valid,
  CASE WHEN role = 'system' OR length(t) >= 20 THEN '' ELSE '$.question: length out of bounds' END AS problems,
  '{"arguments":{' || CASE WHEN role = 'system' THEN '"prompt":' || to_json(t) ELSE '"question":' || to_json(t) || ',"turn":' || turn END
  || '},"id":"' || own || '","name":"' || CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
FROM j
"""
