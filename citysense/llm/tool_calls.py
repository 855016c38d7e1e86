"""Operator 1 [native]: chat formatting with linked tool calls.

*Linking.* Calls and results are reduced to one row for each (conversation,
identifier) by grouped aggregation with map-side partial sums, then hash-joined
on both columns. A conversation that holds a third of all rows is so dealt out
by identifier, and repeated rows of one identifier are summed before they are
shuffled.

*Order.* A call may use the results of other calls of its conversation
(``after``, an array). Its level is the length of the longest chain of calls that
must be answered before it, found by policy iteration: every call points at one
of the calls it waits for; pointer doubling gives the length of all these chains,
so a chain of n calls takes log2 n rounds; then each call points at the one with
the longest chain, until no pointer gets better. Lengths only grow, and few
iterations are enough for usual graphs, however long. Calls whose chain never
ends are in a circle, or behind one, and are marked; an unending chain counts as
the longest, so no circle stays hidden. (conversation, level, turn, call_id) is a
topological order; no conversation is collected or sorted in one task.

*Arguments* are parsed once into Spark's variant type and checked against the
schema of the tool: required keys, unknown keys, kinds of values.

*Canonical JSON.* Keys sorted, no blanks, one spelling for each number; each
message is one line. Everything is built-in DataFrame functions.

Schemas are broadcast only if there are at most ``max_broadcast`` of them, which
is counted first; more of them are joined on (tool, salt), since a few tools
make up most calls.

Defined results: calls or results without an identifier are linked with nothing
(status ``no identifier``); of repeated calls with one identifier the first by
(turn, name, arguments, after) is taken and ``copies`` says how many there were;
of repeated results the first by (turn, content). Arguments that are no JSON
object (null, malformed, repeated keys) have the error ``not an object`` and are
left out of the JSON. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .store import materialize

MAX_BROADCAST = 10_000
SALTS = 64
#: JSON Schema kinds, and how the type of a variant value of that kind begins.
KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",),
    "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",),
}


def _first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    first = F.min(F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*keys).agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).select(*keys, "first.*", "copies")


def _several(calls: DataFrame) -> DataFrame:
    """``after`` as an array."""
    if isinstance(calls.schema["after"].dataType, ArrayType):
        return calls
    return calls.withColumn("after", F.when(F.col("after").isNotNull(), F.array("after")))


def _chain_lengths(nodes: DataFrame, points: DataFrame, longest: int) -> DataFrame:
    """(conv_id, call_id, level): how many pointers (conv_id, call_id, to) lead from each call to one without; null without end."""
    state = materialize(nodes.join(points, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.col("to").alias("next"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("level")))
    reach = 1
    while reach <= longest and not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("further"), F.col("level").alias("more"))
        state = materialize(state.join(ahead, ["conv_id", "next"], "left").select(
            "conv_id", "call_id", F.col("further").alias("next"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("next").isNull(), F.col("level")).alias("level"))


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls (conv_id, call_id, after), by the longest chain before each. ``level``
    is null for calls in a circle, or behind one. What ``after`` names and the conversation lacks counts as nothing."""
    node = ["conv_id", "call_id"]
    # where calls have a turn, a pointer starts at the latest of the calls waited for: mostly it has the longest chain
    turn = F.col("turn") if "turn" in calls.columns else F.lit(0)
    nodes = materialize(_several(calls).select(*node, "after", turn.alias("turn")))
    named = nodes.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("of"))
    waits = materialize(nodes.select(*node, F.explode(F.array_distinct("after")).alias("before")).join(named, ["conv_id", "before"]))
    longest = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    points = waits.groupBy(*node).agg(F.max(F.struct("of", "before")).alias("last")).select(*node, F.col("last.before").alias("to"))
    single = waits.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    while True:
        levels = _chain_lengths(nodes.select(*node), points, longest)
        if single:  # no call has a choice
            return levels
        levels = materialize(levels)
        of = levels.select("conv_id", F.col("call_id").alias("before"), F.coalesce("level", F.lit(longest + 1)).alias("ahead"))
        best = waits.join(of, ["conv_id", "before"]).groupBy(*node).agg(F.max(F.struct("ahead", "before")).alias("best"))
        now = materialize(points.join(best, node).join(levels, node).select(
            *node, "to", "best", (F.col("best.ahead") + 1 > F.coalesce("level", F.lit(longest + 2))).alias("better")))
        if now.where("better").isEmpty():
            return levels
        points = now.select(*node, F.when(F.col("better"), F.col("best.before")).otherwise(F.col("to")).alias("to"))


def _with_schemas(calls: DataFrame, schemas: DataFrame, max_broadcast: int) -> DataFrame:
    """Each call with ``properties`` (key to kind) and ``required`` of its tool; null for unknown tools."""
    known = schemas.groupBy("name").agg(F.min_by("properties", F.to_json("properties")).alias("properties"),
                                        F.min("required").alias("required"), F.lit(True).alias("known"))
    if known.count() <= max_broadcast:
        return calls.join(F.broadcast(known), "name", "left")
    salted = calls.withColumn("salt", F.pmod(F.xxhash64("conv_id", "call_id"), F.lit(SALTS)).cast("int"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["name", "salt"], "left").drop("salt")


def argument_errors(arguments: Column, properties: Column, required: Column, known: Column) -> Column:
    """Sorted error texts for arguments (variant, or null if no object); an empty array for valid ones."""
    values = arguments.cast("map<string,variant>")
    keys = F.map_keys(values)

    def wrong(key: Column) -> Column:
        kind, is_ = properties[key], F.schema_of_variant(values[key])
        fits = F.lit(False)
        for name, begins in KINDS.items():
            fits = fits | ((kind == name) & F.coalesce(F.array_contains(F.array(*map(F.lit, begins)), F.regexp_extract(is_, "^[A-Z]+", 0)), F.lit(False)))
        # a number without a fraction is an integer, however it was written
        whole = (kind == "integer") & is_.startswith("DECIMAL") & is_.endswith(",0)")
        return ~(fits | whole)

    missing = F.transform(F.array_except(required, keys), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_except(keys, F.map_keys(properties)), lambda k: F.concat(F.lit("unknown "), k))
    kinds = F.transform(F.filter(F.array_intersect(keys, F.map_keys(properties)), wrong),
                        lambda k: F.concat(F.lit("not "), F.concat_ws(" ", properties[k], k)))
    return (F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool")))
            .when(values.isNull(), F.array(F.lit("not an object")))
            .otherwise(F.array_sort(F.concat(missing, unknown, kinds))))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each call, and for each result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (array of call_ids, one call_id, or null);
    ``results``: conv_id, call_id, turn, content; ``schemas``: name, properties
    (map of argument to JSON Schema kind), required (array).

    Columns: conv_id, call_id, turn, level, status (``linked``, ``no result``, ``no call``, ``no
    identifier``, ``circular``), copies, valid, errors, json (canonical, one line).
    """
    calls = _several(calls).select("conv_id", "call_id", "turn", "name", "arguments", "after")
    results = results.select("conv_id", "call_id", "turn", "content")
    given = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = materialize(_first_of(calls.where(given), ["conv_id", "call_id"], ["turn", "name", "arguments", "after"]))
    answers = (_first_of(results.where(given), ["conv_id", "call_id"], ["turn", "content"]).drop("copies")
               .withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True)))
    placed = own.withColumn("called", F.lit(True)).join(call_levels(own), ["conv_id", "call_id"])
    linked = placed.join(answers, ["conv_id", "call_id"], "full").withColumn("status", (
        F.when(F.col("called").isNull(), "no call").when(F.col("level").isNull(), "circular")
        .when(F.col("answered").isNull(), "no result").otherwise("linked")))

    def loose(rows: DataFrame, **named: str) -> DataFrame:
        rows = rows.where(~given).withColumn("status", F.lit("no identifier"))
        return rows.select(*[F.col(named.get(f.name, f.name)).alias(f.name) if named.get(f.name, f.name) in rows.columns
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in linked.schema])

    every = (linked.unionByName(loose(calls.withColumn("called", F.lit(True))))
             .unionByName(loose(results, result_turn="turn").withColumn("turn", F.lit(None).cast(linked.schema["turn"].dataType))))
    every = _with_schemas(every.withColumn("copies", F.coalesce("copies", F.lit(1))), schemas, max_broadcast)
    parsed = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    every = every.withColumn("parsed", F.when(is_object, parsed))
    checked = every.withColumn("errors", F.when(F.col("called"), argument_errors(
        F.col("parsed"), F.col("properties"), F.col("required"), F.col("known"))).otherwise(F.array().cast("array<string>")))
    line = F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", "content", "conv_id", "name", "result_turn", "status", "turn"))
    return checked.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "level", "status", "copies",
                          (F.size("errors") == 0).alias("valid"), "errors", line.alias("json"))
