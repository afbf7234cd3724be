"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet by (conversation, identifier) in a hash-partitioned join, after results have been summed
up by identifier. An argument whose whole value is ``$<identifier>`` depends on the result
of that call in the same conversation; calls are ordered by level: one more than the highest level
they depend on (one join for each level of the longest chain). Arguments are checked against the
tool's parameters. Every call becomes one canonical JSON record: keys sorted, no spaces, numbers
as a VARIANT keeps them. Records are rows, so a conversation of any length is never gathered.

Where messages carry no tool traffic, ``turn_traffic`` reads a conversation itself as such: each user
turn is a call of the tool ``reply`` with the text as its prompt, and the assistant turn that
follows it directly is its result.

Defined results: null conversations, identifiers and turns link with nothing; of calls that repeat
an identifier the first (by turn, place, name and arguments; one of equal rows) takes the result and the others are marked
``repeated identifier``; of several results the first counts and ``n_results`` tells how many
there are; results without a call are rows of their own; arguments that are no JSON object are
``not an object``; a call in a cycle, or behind one, has no level and is marked ``cycle``; a
reference to no call is marked ``unknown reference``; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import stash

#: name, parameter, type (string, integer, number, boolean, object, array), required
REPLY = [("reply", "prompt", "string", True)]
TOOL = "name string, parameter string, type string, required boolean"

MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant>>,tool_call_id:string,content:string>"
COPIES = 4096  # of equal rows, numbered in one array
CALLS = ("conv_id", "call_id", "turn", "place", "name", "arguments")


def message_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages whose text is a JSON object with tool_calls or a tool_call_id."""
    rows = messages.filter(F.ltrim("text").startswith("{")).select("conv_id", "turn", "role", F.from_json("text", MESSAGE).alias("m"))
    calls = rows.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), F.col("turn").cast("long").alias("turn"), "place", F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"))
    results = rows.filter("role = 'tool' and m.tool_call_id is not null")
    return calls, results.select("conv_id", F.col("m.tool_call_id").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("m.content").alias("content"))


def turn_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain turns: user turn k is call ``turn-k``, assistant turn k+1 its result."""
    call_id = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    turn = F.col("turn").cast("long")
    prompt = F.to_json(F.struct(F.col("text").cast("string").alias("prompt")), {"ignoreNullFields": "false"})
    calls = messages.filter("role = 'user'").select("conv_id", call_id(turn).alias("call_id"), turn.alias("turn"), F.lit(0).alias("place"), F.lit("reply").alias("name"), prompt.alias("arguments"))
    results = messages.filter("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), turn.alias("turn"), F.col("text").cast("string").alias("content"))
    return calls, results


def _kind(t: Column) -> Column:
    """JSON type of a VARIANT's schema."""
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t.rlike(r"^DECIMAL\([0-9]+,0\)"), "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null")
    )


def _errors(calls: DataFrame, tools: DataFrame, opaque: tuple[str, ...]) -> DataFrame:
    """``calls`` with ``errors``, what is wrong with their arguments, and ``refs``, the calls they refer to.

    A reference may stand for a value of any type. Arguments of ``opaque`` tools hold none.
    """
    refers = lambda v: (F.schema_of_variant(v) == "STRING") & v.cast("string").rlike(r"^\$[^\s]+$") & ~F.col("name").isin(*opaque)
    params = tools.groupBy("name").agg(F.collect_list(F.struct("parameter", "type", "required")).alias("params"))
    rows = calls.withColumn("given", F.from_json("arguments", "map<string,variant>"))
    rows = rows.join(params.withColumnRenamed("name", "tool"), F.col("name") == F.col("tool"), "left")
    kinds = F.transform(F.map_entries("given"), lambda e: F.struct(e["key"].alias("key"), F.when(refers(e["value"]), "reference").otherwise(_kind(F.schema_of_variant(e["value"]))).alias("kind")))
    rows = rows.withColumn("kinds", kinds)
    known = lambda p, e: p["parameter"] == e["key"]
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.exists("kinds", lambda e: known(p, e))), lambda p: F.concat(F.lit("missing "), p["parameter"]))
    extra = F.transform(F.filter("kinds", lambda e: ~F.exists("params", lambda p: known(p, e))), lambda e: F.concat(F.lit("unexpected "), e["key"]))
    fits = lambda p, e: (p["type"] == e["kind"]) | (e["kind"] == "reference") | ((p["type"] == "number") & (e["kind"] == "integer"))
    wrong = F.transform(F.filter("kinds", lambda e: F.exists("params", lambda p: known(p, e) & ~fits(p, e))), lambda e: F.concat(F.lit("type of "), e["key"]))
    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, extra, wrong)))
    refs = F.transform(F.filter(F.map_entries("given"), lambda e: F.coalesce(refers(e["value"]), F.lit(False))), lambda e: e["value"].cast("string"))
    refs = F.array_distinct(F.transform(refs, lambda v: v.substr(F.lit(2), F.length(v))))
    return rows.withColumn("errors", errors).withColumn("refs", F.coalesce(refs, F.array().cast("array<string>"))).drop("given", "params", "tool", "kinds")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, lost): level is null in and behind cycles; lost: a reference to no call."""
    names = calls.select("conv_id", "call_id").distinct()
    need = calls.filter("size(refs) > 0").select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct()
    have = names.select(F.col("conv_id").alias("c"), F.col("call_id").alias("r"))
    need = stash(need.join(have, (F.col("conv_id") == F.col("c")) & (F.col("ref") == F.col("r")), "left").select("conv_id", "call_id", "ref", F.col("r").isNull().alias("lost")), "needs")
    lost = need.groupBy("conv_id", "call_id").agg(F.max("lost").alias("lost"), F.sum(F.when(F.col("lost"), 0).otherwise(1)).alias("wants"))
    open_calls = lost.filter("wants > 0")
    edges = need.filter("not lost").select("conv_id", "call_id", "ref")
    free = names.join(open_calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    if not edges.isEmpty():
        free = stash(free, "levels")
        while True:
            met = edges.join(free.select("conv_id", F.col("call_id").alias("ref"), "level"), ["conv_id", "ref"])
            met = met.groupBy("conv_id", "call_id").agg(F.max("level").alias("top"), F.count("*").alias("n"))
            met = met.join(open_calls, ["conv_id", "call_id"]).filter("n = wants").join(free.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
            step = stash(met.select("conv_id", "call_id", (F.col("top") + 1).alias("level")), "level")
            if step.isEmpty():
                break
            free = free.unionByName(step)
    out = names.join(free, ["conv_id", "call_id"], "left").join(lost.select("conv_id", "call_id", "lost"), ["conv_id", "call_id"], "left")
    return out.select("conv_id", "call_id", "level", F.coalesce("lost", F.lit(False)).alias("lost"))


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame, opaque: tuple[str, ...] = ("reply",)) -> DataFrame:
    """Calls with their results, levels, errors and canonical JSON; results without a call behind them."""
    key, order = ["conv_id", "call_id"], F.struct("turn", "place", "name", "arguments", "copy")
    copies = calls.groupBy(*CALLS).agg(F.count("*").alias("copies"))  # equal rows are told apart by a number
    copies = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("lot"))
    copies = copies.select(*CALLS, F.explode(F.sequence(F.col("lot") * COPIES + 1, F.least("copies", (F.col("lot") + 1) * COPIES))).alias("copy"))
    calls = _errors(copies, tools, opaque)
    first = calls.groupBy(*key).agg(F.min(order).alias("first"))
    sums = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    rows = calls.join(first, key, "left").join(sums, key, "left").join(_levels(calls), key, "left")
    again = F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    level = F.when(known, F.col("level")).otherwise(F.lit(0))
    marks = [(again, "repeated identifier"), (~known, "no identifier"), (known & F.col("level").isNull(), "cycle"), (F.coalesce("lost", F.lit(False)), "unknown reference")]
    marks = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in marks]), lambda x: x.isNotNull())
    errors = F.array_sort(F.concat("errors", marks))
    rows = rows.withColumn("errors", errors).withColumn("level", level).withColumn("result", F.when(~again, F.col("r.content"))).withColumn("result_turn", F.when(~again, F.col("r.turn")))
    n = F.when(again, F.lit(0)).otherwise(F.coalesce("n_results", F.lit(0))).cast("long")
    rows = rows.select(*CALLS, "errors", "level", "result", "result_turn", n.alias("n_results"))
    canonical = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("errors"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("result"), F.col("turn")
    )
    out = rows.select(
        "conv_id", "call_id", "turn", F.col("place").cast("long").alias("place"), F.col("level").cast("long").alias("level"), "n_results", "result_turn",
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), F.to_json(canonical, {"ignoreNullFields": "false"}).alias("json"),
    )
    lone = results.alias("r").join(first.select(*[F.col(c).alias(f"f_{c}") for c in key]), (F.col("r.conv_id") == F.col("f_conv_id")) & (F.col("r.call_id") == F.col("f_call_id")), "left_anti")
    record = F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), F.col("turn"))
    none = lambda t: F.lit(None).cast(t)
    lone = lone.select(
        "conv_id", "call_id", none("long").alias("turn"), none("long").alias("place"), none("long").alias("level"), F.lit(1).cast("long").alias("n_results"), F.col("turn").alias("result_turn"),
        F.lit(False).alias("valid"), F.lit("no call").alias("errors"), F.to_json(record, {"ignoreNullFields": "false"}).alias("json"),
    )
    return out.unionByName(lone)


def conversation_calls(messages: DataFrame) -> DataFrame:
    """Tool traffic of messages, and of plain conversations read as calls of ``reply``."""
    spark = messages.sparkSession
    messages = messages.select("conv_id", "turn", "role", "text")
    calls, results = message_traffic(messages)
    plain = messages.filter(~F.coalesce(F.from_json("text", MESSAGE)["tool_calls"].isNotNull() | F.from_json("text", MESSAGE)["tool_call_id"].isNotNull(), F.lit(False)))
    more_calls, more_results = turn_traffic(plain)
    return link_calls(calls.unionByName(more_calls), results.unionByName(more_results), spark.createDataFrame(REPLY, TOOL))
