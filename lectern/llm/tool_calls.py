"""Tool-call linking: calls joined to results, ordered, validated and written as canonical JSON.

Calls and results meet in an equi-join on (conversation, identifier). Calls that
name other calls they depend on get a topological level, the longest way to a call without
dependencies. A dependency says ``level >= max(floor, level of the needed call + weight)``;
such bounds compose and merge, so that rounds of joins can shrink the graph from everywhere at once:

1. A dependency that two others in a row imply goes (call 5 needs 4 and 3, 4 needs 3), as
   long as all three lead to earlier calls.
2. Calls with one open dependency make up chains: pointer doubling composes the bounds
   along them, in a logarithmic number of joins, and calls that need them are hung onto the chains' heads.
3. Dependencies on one head merge into one. Those on calls with a known level become floors;
   a call without open dependencies gets its level.

Chains, ladders and diamonds are settled in a logarithmic number of joins whatever their
length; every round settles a call at least. What no round reaches depends on a
cycle. Every round is written to the checkpoint folder.

Arguments are parsed once (``parse_json``), checked against a table of parameters by
the type of each value, and written as JSON without blanks, keys sorted at all depths.

Main path: DataFrame functions only. A conversation's order is the sort order of
(``level``, ``turn``, ``call_id``), a column of each row: no task gathers a
conversation, however long it is.

Defined results. Of repeated calls or results with one identifier the smallest
(turn, then content) counts, and ``duplicates`` says how many rows there were;
calls with a null conversation or identifier take part in no link and get no row.
A missing result gives null ``result`` and the error ``no_result``. A dependency on
an unknown call gives ``unknown_dependency`` and does not delay the call; one on
a cycle gives level -1 and ``dependency_cycle``. Null arguments count as an empty
object; arguments that are no JSON object, or repeat a key, give ``not_an_object`` and are
written as an empty one. A null value counts as missing. Numbers are written plainly
(2.50 as 2.5), whole ones count as integers. Values of a wrong type are reported
(``type:name``) and stay as they are. Columns beyond those named are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage

#: Level tables that are joined into one written table at a time.
GATHERED = 16


def json_string(value: Column) -> Column:
    """``value`` as a JSON string with its quotes."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, constraints on its columns included: those a table inherits double with each join to its own successors."""
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set(name, before)


KEYS = ["conv_id", "call_id"]


def chain_heads(single: DataFrame) -> DataFrame:
    """``conv_id, call_id, head, weight, floor`` of calls with one open dependency (needs, weight, floor): the bound by the first call on the way that has not one.

    Calls that lead into a circle of such calls have no head and no row. Each round doubles how far the pointers reach.
    """
    known = single.select("conv_id", F.col("call_id").alias("needs"), F.lit(False).alias("done"))
    state = written(single.join(known, ["conv_id", "needs"], "left").select(*KEYS, F.col("needs").alias("head"), "weight", "floor", F.coalesce("done", F.lit(True)).alias("done")))
    for _ in range(state.count().bit_length()):
        if not state.where(~F.col("done")).limit(1).count():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("weight").alias("more"), F.col("floor").alias("below"), F.col("done").alias("arrived"))
        going = state.where(~F.col("done")).join(ahead, ["conv_id", "head"])
        going = going.select(*KEYS, F.col("next").alias("head"), (F.col("weight") + F.col("more")).alias("weight"), F.greatest("floor", F.col("weight") + F.col("below")).alias("floor"), F.col("arrived").alias("done"))
        state = written(state.where("done").unionByName(going))
    return state.where("done").drop("done")


def _merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*KEYS, "needs").agg(F.max("weight").alias("weight"), F.max("floor").alias("floor"))


def _without_implied(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``edges`` less those whose bound two others in a row give; only among edges to calls that come earlier, where no circle can be lost."""
    at = lambda name, to: order.select("conv_id", F.col("call_id").alias(name), F.col("at").alias(to))
    back = edges.join(at("call_id", "from"), KEYS).join(at("needs", "to"), ["conv_id", "needs"]).where(F.col("from") > F.col("to"))
    back = back.select(*KEYS, "needs", "weight", "floor")
    second = back.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("end"), F.col("weight").alias("more"))
    ways = back.join(second, ["conv_id", "needs"]).groupBy(*KEYS, F.col("end").alias("needs")).agg(F.max(F.col("weight") + F.col("more")).alias("around"))
    implied = back.join(ways, [*KEYS, "needs"]).where(F.col("around") >= F.col("weight"))
    # a call's floor stands on all of its edges, of which one at least stays
    return edges.join(implied.select(*KEYS, "needs"), [*KEYS, "needs"], "left_anti")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without dependencies, else 1 + the highest level of those; -1 on or after a cycle.

    ``edges`` (conv_id, call_id, needs) hold known calls only; ``calls`` may have ``turn``, which tells what comes earlier.
    """
    turn = F.col("turn") if "turn" in calls.columns else F.lit(0)
    order = written(calls.select(*KEYS, F.struct(turn.cast("long").alias("t"), F.col("call_id").alias("c")).alias("at")))
    left = written(edges.distinct().select(*KEYS, "needs", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("floor")))
    known = written(order.select(*KEYS).join(left.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("level", F.lit(0).cast("long")))
    settled, chains, size = [known], [], left.count()
    while size:
        # dependencies on calls with a level become floors
        met = left.join(known.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        met = met.select(*KEYS, F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), "weight", F.coalesce(F.greatest("floor", F.col("level") + F.col("weight")), F.col("floor")).alias("floor"))
        base = met.groupBy(*KEYS).agg(F.max("floor").alias("base"), F.count("needs").alias("open"))
        open_edges = written(met.where(F.col("needs").isNotNull()).join(base, KEYS).select(*KEYS, "needs", "weight", F.col("base").alias("floor")))
        known = written(base.where("open = 0").select(*KEYS, F.col("base").alias("level")))
        settled.append(known)
        fewer = written(_merged(_without_implied(open_edges, order)))
        lone = fewer.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("needs").alias("needs"), F.first("weight").alias("weight"), F.first("floor").alias("floor")).where("n = 1").drop("n")
        lone = written(lone)
        heads = written(chain_heads(lone))
        several = fewer.join(lone.select(*KEYS), KEYS, "left_anti")
        on_chain = lone.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("chained"))
        hung = several.join(on_chain, ["conv_id", "needs"], "left").join(heads.select("conv_id", F.col("call_id").alias("needs"), "head", F.col("weight").alias("more"), F.col("floor").alias("below")), ["conv_id", "needs"], "left")
        # what needs a chain that ends in a circle stays open for ever, as that chain's calls do: it goes on needing it
        hung = hung.select(*KEYS, F.coalesce("head", "needs").alias("needs"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), F.greatest("floor", F.coalesce(F.col("weight") + F.col("below"), F.lit(0))).alias("floor"))
        chains.append(heads)
        settled_now, old = known.count(), size
        left = written(_merged(hung))
        size = left.count()
        if not settled_now and size == old:
            break
        if len(settled) == GATHERED:
            settled = [written(reduce(DataFrame.unionByName, settled))]
        # a round looks at new levels only; heads of chains get theirs from all that is known
        known = written(reduce(DataFrame.unionByName, settled).join(left.select("conv_id", F.col("needs").alias("call_id")).distinct(), KEYS, "left_semi")) if size else known
    found = written(reduce(DataFrame.unionByName, settled))
    for heads in reversed(chains):
        more = heads.join(found.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("base")), ["conv_id", "head"])
        found = written(found.unionByName(more.select(*KEYS, F.greatest("floor", F.col("base") + F.col("weight")).alias("level"))))
    return found.unionByName(order.select(*KEYS).join(found.select(*KEYS), KEYS, "left_anti").withColumn("level", F.lit(-1).cast("long")))


#: What ``schema_of_variant`` calls the values of each type of parameter.
KINDS = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$",
    "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<",
    "array": r"^ARRAY<",
}


def _checked(arguments: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per call: canonical arguments and sorted argument errors.

    ``arguments``: conv_id, call_id, name, arguments (JSON). ``schemas``: name, param, type, required.
    """
    parsed = arguments.withColumn("v", F.try_parse_json(F.coalesce("arguments", F.lit("{}"))))
    parsed = parsed.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT<"), F.col("v")))
    kinds = F.transform_values(F.col("v").cast("map<string,variant>"), lambda k, x: F.schema_of_variant(x))
    parsed = parsed.withColumn("kinds", F.map_filter(kinds, lambda k, x: x.isNotNull()))
    rules = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("rules"))
    # a few hundred tools with a few dozen parameters each: broadcast only below a stated size, else a plain join
    small = rules.limit(2_000).count() < 2_000
    with_rules = parsed.join(F.broadcast(rules) if small else rules, "name", "left")
    fits = lambda r, kind: reduce(lambda out, k: F.when(r["type"] == k, kind.rlike(KINDS[k])).otherwise(out), KINDS, F.lit(True))

    def wrong(r: Column) -> Column:
        kind = F.element_at("kinds", r["param"])
        absent = F.when(r["required"], F.concat(F.lit("missing:"), r["param"]))
        return F.when(kind.isNull() | (kind == "VOID"), absent).when(~fits(r, kind), F.concat(F.lit("type:"), r["param"]))

    extra = F.transform(F.array_except(F.map_keys("kinds"), F.transform("rules", lambda r: r["param"])), lambda k: F.concat(F.lit("unknown:"), k))
    errors = (
        F.when(F.col("v").isNull(), F.array(F.lit("not_an_object")))
        .when(F.col("rules").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort(F.filter(F.concat(F.transform("rules", wrong), extra), lambda e: e.isNotNull())))
    )
    return with_rules.select("conv_id", "call_id", errors.alias("errors"), F.coalesce(F.to_json("v"), F.lit("{}")).alias("arguments"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call.

    ``calls``: conv_id, turn, call_id, name, arguments (a JSON object), needs (array of call ids).
    ``results``: conv_id, turn, call_id, content. ``schemas``: name, param, type
    (string, integer, number, boolean, object or array), required. Other columns are ignored.
    Returns conv_id, turn, call_id, level, duplicates, errors and ``message``, the canonical JSON.
    """
    keys = ["conv_id", "call_id"]
    known = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    known = known.groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count("*").alias("duplicates")).select(*keys, "c.*", "duplicates")
    known = cut_lineage(known)
    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r")).select(*keys, F.col("r.content").alias("result"), F.lit(True).alias("answered"))
    wanted = known.select(*keys, F.explode(F.array_distinct("needs")).alias("needs")).where(F.col("needs").isNotNull())
    target = known.select("conv_id", F.col("call_id").alias("needs"))
    edges = cut_lineage(wanted.join(target, ["conv_id", "needs"], "left_semi").select("conv_id", "call_id", "needs"))
    unknown = wanted.join(target, ["conv_id", "needs"], "left_anti").select(*keys).distinct().withColumn("lost", F.lit(True))
    level = levels(known, edges)
    checked = _checked(known.select(*keys, "name", "arguments"), schemas)
    every = known.select(*keys, "turn", "name", "duplicates").join(answers, keys, "left").join(level, keys).join(unknown, keys, "left").join(checked, keys)
    more = F.array(F.when(F.col("answered").isNull(), "no_result"), F.when(F.col("lost"), "unknown_dependency"), F.when(F.col("level") < 0, "dependency_cycle"))
    errors = F.concat("errors", F.filter(more, lambda e: e.isNotNull()))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(json_string(F.col(c).cast("string")))
    message = F.concat(
        F.lit('{"arguments":'), "arguments", F.lit(',"errors":['), F.array_join(F.transform("errors", json_string), ","), F.lit('],"id":'), text("call_id"), F.lit(',"level":'), F.col("level").cast("string"),
        F.lit(',"name":'), text("name"), F.lit(',"result":'), text("result"), F.lit("}"),
    )
    return every.withColumn("errors", errors).select("conv_id", "turn", "call_id", "level", "duplicates", "errors", message.alias("message"))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) in plain conversations, whose turns carry no calls of their own.

    A user's turn is a call of ``answer`` with the question and its length, named
    by its turn, which depends on the call of half its turn number; an assistant's turn
    is the result of the call one turn before.
    """
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    half = F.floor(turn / 2)
    calls = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", name(turn).alias("call_id"), F.lit("answer").alias("name"), F.to_json(F.struct(F.col("text").alias("question"), F.length("text").alias("n_chars"))).alias("arguments"),
        F.when(turn > 0, F.array(name(half))).alias("needs"),
    )
    results = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
