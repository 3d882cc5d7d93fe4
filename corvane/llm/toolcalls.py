"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and identifier; calls are put in topological
order of what they wait for (chains by doubling pointers, the rest by rounds, each checkpointed); arguments
are validated against the tool's schema; and each linked call is serialised as canonical JSON (members
sorted, no blanks). Everything is native.

A result may come several times: the earliest counts, the number is kept. No key is collected: results are
aggregated before the join, and a conversation with a third of all calls is only rows of a
join whose skewed partitions adaptive execution splits.

Defined cases: a call without identifier or conversation links to nothing and has problem 'no identifier'; a result without call gives a row with
problem 'no call'. Calls that wait for each other, or for such calls, have no level and problem 'cycle'. Waiting for a call that
isn't there is problem 'missing dependency', and nothing is waited for. Arguments that aren't a JSON object: 'invalid arguments'. An unknown tool: 'unknown tool'. Repeated calls
each get a row. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.common import cut, small

BLOCK = 1024
KEY = ["conv_id", "call_id"]


def quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNotNull(), F.substring(one, F.lit(6), F.length(one) - 6))


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, top, far) of calls that wait for one other: the first call along the chain that doesn't, and the steps to it; top is null where a chain ends in a cycle.

    Pointers double every round, so rounds grow as the logarithm of the longest chain; those that are open after as many rounds as all calls together could need go round in a cycle.
    """
    own = single.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("open"))
    hops = cut(single.withColumnRenamed("waits_for", "top").withColumn("far", F.lit(1).cast("long")).join(own, ["conv_id", "top"], "left").select(*KEY, "top", "far", F.coalesce("open", F.lit(False)).alias("open")))
    for _ in range(hops.count().bit_length() + 1):
        if hops.filter("open").isEmpty():
            break
        ahead = hops.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top2"), F.col("far").alias("far2"), F.col("open").alias("open2"))
        moved = hops.filter("open").join(ahead, ["conv_id", "top"]).select(*KEY, F.col("top2").alias("top"), (F.col("far") + F.col("far2")).alias("far"), F.col("open2").alias("open"))
        hops = cut(hops.filter("not open").unionByName(moved))
    return hops.select(*KEY, F.when(~F.col("open"), F.col("top")).alias("top"), "far")


def levels(calls: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(conv_id, call_id, level) of each distinct identifier that can be ordered; level 0 waits for nothing, others come one level after the last they wait for.

    Chains of calls that wait for one other are contracted first, in logarithmic rounds. What remains is ordered by rounds that each take
    the calls with nothing left to wait for: as many as calls with several dependencies follow one another. Goes on until nothing is left; raises if that takes most_rounds, where given.
    """
    nodes = calls.filter("conv_id is not null and call_id is not null")
    edges = nodes.select(*KEY, F.explode("after").alias("waits_for")).filter("waits_for is not null").distinct()
    there = nodes.select("conv_id", F.col("call_id").alias("waits_for")).distinct()
    waits = cut(edges.join(there, ["conv_id", "waits_for"], "left_semi").select(*KEY, "waits_for"))
    degrees = waits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("waits_for").alias("waits_for"))
    chains = _chains(degrees.filter("n = 1").select(*KEY, "waits_for"))
    several = waits.join(degrees.filter("n > 1").select(*KEY), KEY, "left_semi")
    # edges from calls with several dependencies to the first call along each chain; without one (a cycle) the edge stays open for ever
    along = chains.select("conv_id", F.col("call_id").alias("waits_for"), "top", "far", F.lit(True).alias("chained"))
    left = cut(several.join(along, ["conv_id", "waits_for"], "left").select(*KEY, F.when(F.col("chained"), F.col("top")).otherwise(F.col("waits_for")).alias("top"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("long").alias("value")))
    front = cut(nodes.select(*KEY).distinct().join(degrees.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0).cast("long")))
    done = front
    for round_ in count(1):
        if left.isEmpty():
            break
        if round_ == most_rounds:
            raise RuntimeError(f"levels did not settle in {most_rounds} rounds")
        ready = front.select("conv_id", F.col("call_id").alias("top"), "level")
        left = cut(left.join(ready, ["conv_id", "top"], "left").select(*KEY, "top", "far", F.coalesce("value", F.col("level") + F.col("far")).alias("value")))
        front = cut(left.groupBy(*KEY).agg(F.max("value").alias("level"), F.count_if(F.col("value").isNull()).alias("open")).filter("open = 0").select(*KEY, "level"))
        if front.isEmpty():
            break  # only cycles are left
        left = left.join(front.select(*KEY), KEY, "left_anti")
        done = done.unionByName(front)
        if round_ % 100 == 0:
            done, left = cut(done), cut(left)  # many rounds would make a plan of as many unions
    tops = done.select("conv_id", F.col("call_id").alias("top"), "level")
    chained = chains.join(tops, ["conv_id", "top"]).select(*KEY, (F.col("level") + F.col("far")).alias("level"))
    return done.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, position, name, n_results, problems, message) of each call, and of each result without one.

    calls (conv_id, call_id, turn, name, arguments, after array<string>); results (conv_id, call_id, turn, content);
    schemas (name, field, type, required), a row for each field of each tool, types as Spark names those of variants.
    """
    answered = results.filter("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min_by("content", F.struct("turn", "content")).alias("content"), F.count(F.lit(1)).alias("n_results"))
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    waits = calls.select(*KEY, "turn", "name", "arguments", "after")
    order = levels(waits)
    known = waits.filter("conv_id is not null and call_id is not null").join(order, KEY, "left")
    named = known.unionByName(waits.filter("conv_id is null or call_id is null").withColumn("level", F.lit(None).cast("int")))
    there = waits.select("conv_id", F.col("call_id").alias("waits_for")).distinct()
    missing = waits.select(*KEY, F.explode("after").alias("waits_for")).join(there, ["conv_id", "waits_for"], "left_anti").select(*KEY).distinct().withColumn("missing", F.lit(True))
    linked = named.withColumn("is_call", F.lit(True)).join(answered, KEY, "full_outer").join(missing, KEY, "left").join(small(tools), "name", "left")
    value = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    given = F.when(is_object, F.transform(F.map_entries(F.from_json("arguments", "map<string,variant>")), lambda e: F.struct(e["key"].alias("field"), F.regexp_replace(F.schema_of_variant(e["value"]), r"[(<].*", "").alias("type"))))
    rows = linked.withColumn("value", value).withColumn("is_object", is_object).withColumn("given", F.coalesce(given, F.array().cast("array<struct<field:string,type:string>>")))
    fields = F.coalesce("fields", F.array().cast("array<struct<field:string,type:string,required:boolean>>"))
    absent = F.exists(fields, lambda f: f["required"] & ~F.exists("given", lambda g: g["field"] == f["field"]))
    wrong = F.exists("given", lambda g: F.exists(fields, lambda f: (f["field"] == g["field"]) & (f["type"] != g["type"])))
    extra = F.exists("given", lambda g: ~F.exists(fields, lambda f: f["field"] == g["field"]))
    call = F.coalesce("is_call", F.lit(False))
    checks = call & F.col("is_object") & F.col("fields").isNotNull()
    problems = F.concat_ws(
        ",",
        F.when(~call, "no call"),
        F.when(call & (F.col("conv_id").isNull() | F.col("call_id").isNull()), "no identifier"),
        F.when(call & F.col("n_results").isNull(), "no result"),
        F.when(call & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle"),
        F.when(call & F.coalesce("missing", F.lit(False)), "missing dependency"),
        F.when(call & ~F.col("is_object"), "invalid arguments"),
        F.when(call & F.col("fields").isNull(), "unknown tool"),
        F.when(checks & absent, "missing field"),
        F.when(checks & wrong, "wrong type"),
        F.when(checks & extra, "unknown field"),
    )
    # members in order of their names, as those inside a variant are
    member = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))
    parts = (member("arguments", F.when(F.col("is_object"), F.to_json("value"))), member("content", quoted(F.col("content"))), member("id", quoted(F.col("call_id"))), member("name", quoted(F.col("name"))))
    message = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = rows.withColumn("_message", message).withColumn("_problems", problems)
    # the place within the conversation: counted in blocks of turns, so that a long conversation isn't one task
    rows = rows.withColumn("_block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    blocks = rows.filter("level is not null").groupBy("conv_id", "level", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("conv_id", "level", "_block", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "level", "_block").orderBy("turn", "call_id"))
    rows = rows.withColumn("_inside", inside).join(offsets, ["conv_id", "level", "_block"], "left")
    position = (F.col("_before") + F.col("_inside")).cast("long")
    return rows.select("conv_id", "call_id", "level", position.alias("position"), "name", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("_problems").alias("problems"), F.col("_message").alias("message"))
