"""Chat formatting: tool-call linking (native DataFrame operations only).

* Calls and results are joined on (conversation, call id).  Results are first
  reduced to one row an id (their number, and the first by turn), so repeated ids do not multiply rows.
* Calls are ordered topologically by what they depend on: level 0 depends on nothing, others
  stand one level above the highest call they depend on.  Chains of calls with one dependency each are
  shortened by pointer doubling (a conversation of thousands of turns takes a dozen rounds); calls with several
  dependencies are then peeled off round by round, as many rounds as such calls follow each other.  All of it are
  joins on (conversation, id), checkpointed after each round.  Calls on or behind a cycle have no level.
* Arguments (JSON) are parsed as variants and checked against the tool's schema in the row: the
  schemas are configuration, and stand as a constant in the plan.
* A call is serialised as JSON of one form: keys in code-point order, no white space, absent values left out, numbers as
  Spark's variants print them (1.0 as 1, but 1e0 as 1.0; integers beyond 38 digits as doubles).  A number is an
  integer if its value is, however it is spelled.

Defined results: a call without conversation or id has status ``no_id`` and is neither
linked nor a dependency; results without them, and messages without a role, are left out; a result that no call
names gives a row of status ``orphan_result``; of several results the first counts and
the status is ``many_results``; arguments that are null, no JSON object, or repeat a key are
``not an object``; a dependency on an id that no call of the conversation has is the error
``unknown call``, and does not count for the order; repeated calls are a row each.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.llm.common import narrow
from quadrant.session import materialize


@dataclass(frozen=True)
class Param:
    """One parameter of a tool.  least and most bound a number, or a string's length."""

    name: str
    type: str  # string, integer, number, boolean, array or object
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] | None = None


SPEC = ("map<string,array<struct<name:string,type:string,required:boolean,least:double,most:double,"
        "allowed:array<string>>>>")


def argument_errors(name: str, arguments: str, schemas: dict[str, list[Param]]) -> Column:
    """What is wrong with a call's arguments (column names of the tool's name and of
    the arguments as a variant), in the schema's order, then unknown keys."""
    spec = F.from_json(F.lit(json.dumps({t: [asdict(p) for p in ps] for t, ps in schemas.items()})), SPEC)
    given = F.col(arguments).cast("map<string,variant>")

    def wrong(p: Column) -> Column:
        value = given[p["name"]]
        kind = F.schema_of_variant(value)
        fits = (F.when(p["type"] == "string", kind == "STRING")
                 .when(p["type"] == "integer", kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (
                     kind.rlike(r"^(DOUBLE|FLOAT)$") & (value.try_cast("double") % 1 == 0)))
                 .when(p["type"] == "number", kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
                 .when(p["type"] == "boolean", kind == "BOOLEAN")
                 .when(p["type"] == "array", kind.startswith("ARRAY"))
                 .otherwise(kind.startswith("OBJECT")))
        size = F.when(p["type"] == "string", F.char_length(value.try_cast("string")).cast("double")).otherwise(
            value.try_cast("double"))
        outside = F.coalesce(size < p["least"], F.lit(False)) | F.coalesce(size > p["most"], F.lit(False))
        return (F.when(value.isNull(), F.when(p["required"], F.concat(F.lit("missing "), p["name"])))
                 .when(~fits, F.concat(F.lit("type "), p["name"]))
                 .when(outside, F.concat(F.lit("range "), p["name"]))
                 .when(~F.array_contains(p["allowed"], value.try_cast("string")), F.concat(F.lit("value "), p["name"])))

    rules = spec[F.col(name)]
    found = F.filter(F.transform(rules, wrong), lambda e: e.isNotNull())
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(given), F.transform(rules, lambda p: p["name"]))),
                          lambda k: F.concat(F.lit("unknown "), k))
    return (F.when(rules.isNull(), F.array(F.lit("unknown tool")))
             .when(F.col(arguments).isNull(), F.array(F.lit("not an object")))
             .otherwise(F.concat(found, unknown)))


def parsed_object(text: str) -> Column:
    """JSON text as a variant; null unless it is an object."""
    value = F.try_parse_json(F.col(text))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def levels(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null on or behind a cycle) of every call that
    depends on another; ``edges`` has conv_id, call_id, parent_id without repeats."""
    keys = ["conv_id", "call_id"]
    edges = materialize(edges)
    parents = materialize(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("up")))
    chains, several = _chain_ends(parents.filter("n = 1").select(*keys, "up")), parents.filter("n > 1").select(*keys)
    nodes = _joins_of_chains(edges, chains, several) if several.count() else several.withColumn("level", F.lit(None).cast("int"))
    ends = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), F.col("level").alias("base"), F.lit(True).alias("joint"))
    below = chains.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("p")), "left")
    base = F.when(F.col("joint"), F.col("base")).otherwise(0)
    return below.select(*keys, F.when(~F.col("open"), base + F.col("dist")).alias("level")).union(nodes)


def _chain_ends(single: DataFrame) -> DataFrame:
    """conv_id, call_id, up, dist, open: for calls with one dependency, the first call up the
    chain that has none or several, and how far it is, by pointer doubling (as many rounds
    as the logarithm of the longest chain).  open: there is none, the chain leads into a cycle."""
    state = materialize(single.withColumn("dist", F.lit(1)).withColumn("open", F.lit(True)))
    before = None
    while True:
        jump = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        state = materialize(state.join(jump, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("p")), "left").select(
            "conv_id", "call_id", F.coalesce("up2", "up").alias("up"),
            F.when(F.col("up2").isNull(), F.col("dist")).otherwise(F.try_add("dist", "dist2")).alias("dist"),
            F.col("up2").isNotNull().alias("open")))
        left = state.filter("open").count()
        if left in (0, before):  # every round ends some chain, unless only cycles are left
            return state
        before = left


def _joins_of_chains(edges: DataFrame, chains: DataFrame, several: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls with several dependencies, peeled off
    round by round over chains shortened to one edge."""
    keys = ["conv_id", "call_id"]
    above = chains.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), "up", "dist", "open")
    ends = several.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("p2"), F.lit(True).alias("waits"))
    end = F.when(F.col("open"), F.lit(None)).otherwise(F.coalesce("up", "parent_id"))
    short = (edges.join(several, keys).join(above, (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("p")), "left")
             .select(*keys, end.alias("end"), (1 + F.coalesce("dist", F.lit(0))).alias("far"))
             .join(ends, (F.col("conv_id") == F.col("c2")) & (F.col("end") == F.col("p2")), "left")
             .select(*keys, "end", "far", F.when(F.col("end").isNotNull() & F.col("waits").isNull(), 0).alias("base")))
    left, found = materialize(short), None
    while True:
        ready = materialize(left.groupBy(*keys).agg(F.count_if(F.col("base").isNull()).alias("n"), F.max(F.col("base") + F.col("far")).alias("level"))
                            .withColumn("level", F.when(F.col("n") == 0, F.col("level"))).drop("n"))
        solved = ready.filter("level IS NOT NULL")
        if not solved.take(1):  # the rest are on or behind cycles
            return ready if found is None else found.union(ready)
        found = solved if found is None else found.union(solved)
        known = solved.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), "level")
        left = materialize(left.join(solved.select(*keys), keys, "left_anti")
                           .join(known, (F.col("conv_id") == F.col("c")) & (F.col("end") == F.col("p")), "left")
                           .select(*keys, "end", "far", F.coalesce("base", "level").alias("base")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Param]]) -> DataFrame:
    """One row per call, and per orphan result: conv_id, call_id, turn, name, status,
    level, errors, record.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (ids);
    results: conv_id, call_id, turn, content."""
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    keys = ["conv_id", "call_id"]
    ids = calls.filter(known).select(*keys).distinct()
    answers = (results.filter(known).groupBy(*keys)
                      .agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("first"))
                      .select(*keys, "n_results", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result")))
    wanted = (calls.filter(known).select(*keys, F.explode(F.array_distinct("depends_on")).alias("parent_id"))
                   .filter("parent_id IS NOT NULL").distinct())
    real = wanted.join(ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p")),
                       (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("p")), "left_semi")
    real = materialize(real)  # read by the order and by the check below
    ranked = levels(real).withColumn("depends", F.lit(True))
    unknown = (wanted.join(real, [*keys, "parent_id"], "left_anti").groupBy(*keys)
                     .agg(F.array_sort(F.collect_set("parent_id")).alias("unknown")))
    linked = (calls.filter(known).join(answers, keys, "left").join(ranked, keys, "left").join(unknown, keys, "left")
              .withColumn("status", F.when(F.col("n_results").isNull(), "no_result")
                          .when(F.col("n_results") > 1, "many_results").otherwise("linked"))
              .withColumn("level", F.when(F.col("depends"), F.col("level")).otherwise(F.lit(0))))
    loose = calls.filter(f"NOT ({known})").withColumns({
        "status": F.lit("no_id"), "level": F.lit(0), "result": F.lit(None).cast("string"),
        "unknown": F.lit(None).cast("array<string>")})
    common = [*keys, "turn", "name", "arguments", "depends_on", "status", "level", "result", "unknown"]
    rows = (linked.select(*common).union(loose.select(*common))
            .withColumn("given", parsed_object("arguments")))
    rows = rows.withColumn("errors", F.concat(
        argument_errors("name", "given", schemas),
        F.coalesce(F.transform("unknown", lambda u: F.concat(F.lit("unknown call "), u)), F.array().cast("array<string>"))))
    orphans = (answers.join(ids, keys, "left_anti")
               .select(*keys, F.col("result_turn").alias("turn"), F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("depends_on"),
                       F.lit("orphan_result").alias("status"), F.lit(None).cast("int").alias("level"), "result",
                       F.lit(None).cast("array<string>").alias("unknown"), F.lit(None).cast("variant").alias("given"),
                       F.array().cast("array<string>").alias("errors")))
    # Fields in code-point order.
    record = F.to_json(F.struct(F.col("given").alias("arguments"), "call_id", F.array_sort(F.array_distinct("depends_on")).alias("depends_on"),
                                "errors", "level", "name", "result", "status"))
    return rows.union(orphans.select(*rows.columns)).select(*keys, "turn", "name", "status", "level",
                                                            F.array_join("errors", ",").alias("errors"), record.alias("record"))


# ---- the conversations table as calls and results ----------------------------------
SCHEMAS = {
    "ask": [Param("after", "string"), Param("query", "string", True, 1, 2_000), Param("words", "integer", True, 1, 60)],
    "configure": [Param("instructions", "string", True, 1, 2_000), Param("words", "integer", True, 1, 60)],
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """A user turn is a call of ``ask``, after the call two turns before it (the one whose answer
    it follows); a system turn is a call of ``configure``."""
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("role IN ('user', 'system')")
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    ask = F.col("role") == "user"
    after = F.when(ask & (F.col("turn") >= 2), _call_id(F.col("turn") - 2))
    return (rows.withColumn("after", after)
                .select("conv_id", _call_id(F.col("turn")).alias("call_id"), "turn",
                        F.when(ask, "ask").otherwise("configure").alias("name"),
                        F.when(ask, F.to_json(F.struct("after", F.col("text").alias("query"), words.alias("words"))))
                        .otherwise(F.to_json(F.struct(F.col("text").alias("instructions"), words.alias("words")))).alias("arguments"),
                        F.filter(F.array("after"), lambda a: a.isNotNull()).alias("depends_on")))


def results_of(conversations: DataFrame) -> DataFrame:
    """An assistant turn is the result of the call in the turn before it."""
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("role = 'assistant'")
    return rows.select("conv_id", _call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
