"""Chat formatting with linked tool calls (operator 7); DataFrame functions only.

Messages become events: calls, results and plain messages.  Calls and results meet in a
hash join on (conversation, call id).  A call may name the calls whose results it uses.
Events keep the order of turns, but a result waits for its call and a call for the results
that it uses: its place is the latest of their turns and its own, and among events of one
place those of a lower level (calls between them and a call that uses none) come first.
Arguments keep their JSON types and are validated against the tool's schema.  Each event is
serialised as canonical JSON: no blanks, keys in order at every depth, no null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, tidy
from locusframe.llm.prefix import running

#: What a message with tool calls, and a tool's message, hold as JSON.
CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:variant,uses:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Type of a parameter -> pattern of its value's type, as ``schema_of_variant`` names it.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
#: Turns of a conversation that are ranked in one task.
SPAN = 64
#: Level of calls in a circle: after any other.
LAST = 2**31 - 1


def events_of(messages: DataFrame, plain_tool: str = "reply") -> DataFrame:
    """Events of a table of messages (conv_id, turn, role, text).

    A role ``tool`` message is the result that its JSON names.  An assistant's JSON with
    ``tool_calls`` gives a call each.  Any other user message calls ``plain_tool`` under the
    id ``t<turn>`` with its text and turn as arguments, and any other assistant message is the
    result of the last such call before it, tool calls in between or not; all else are plain
    messages.  A message that looks like JSON of these kinds but can't be read is plain too.
    """
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    looks = F.col("text").startswith("{")
    m = m.withColumn("calls", F.when((F.col("role") == "assistant") & looks & F.col("text").contains('"tool_calls"'), F.from_json("text", CALLS)))
    m = m.withColumn("result", F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT)))
    own = F.concat(F.lit("t"), F.col("turn"))
    plain = F.to_variant_object(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    # the user's last turn before each turn, over spans of turns
    turns = cut(m.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("asked")))
    asked = running(turns, ["conv_id"], F.floor(F.col("turn") / SPAN), [F.col("turn")], F.col("asked"), "last", "max").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "last")
    m = m.join(asked, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    many = F.size(F.coalesce(F.col("calls.tool_calls"), F.array())) > 0
    one = F.array(F.struct(own.alias("id"), F.lit(plain_tool).alias("name"), plain.alias("arguments"), F.array().cast("array<string>").alias("uses")))
    calls = F.when(many, F.col("calls.tool_calls")).when((F.col("role") == "user") & F.col("turn").isNotNull(), one)
    kind = F.when(calls.isNotNull(), "call").when(F.col("result.tool_call_id").isNotNull() | ((F.col("role") == "assistant") & F.col("turn").isNotNull()), "result").otherwise("message")
    m = m.withColumn("kind", kind).withColumn("each", F.explode_outer(calls))
    answered = F.coalesce(F.col("result.tool_call_id"), F.concat(F.lit("t"), F.coalesce("last", F.col("turn") - 1)))
    return m.select(
        "conv_id",
        "turn",
        "role",
        "kind",
        F.when(F.col("kind") == "call", F.col("each.id")).when(F.col("kind") == "result", answered).alias("call_id"),
        F.col("each.name").alias("name"),
        F.col("each.arguments").alias("arguments"),
        F.coalesce(F.col("each.uses"), F.array().cast("array<string>")).alias("uses"),
        F.when(many, F.col("calls.content")).when(F.col("kind") == "call", None).otherwise(F.coalesce(F.col("result.content"), F.col("text"))).alias("content"),
    )


def faults(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """What is wrong with a call's arguments; a trailing ``?`` marks a parameter as optional.
    A JSON null is no value."""
    args = F.coalesce(arguments.cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kind = lambda p: F.nullif(F.schema_of_variant(F.try_element_at(args, F.lit(p))), F.lit("VOID"))
    none = F.array().cast("array<string>")
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit(""))))
    for tool, params in schemas.items():
        missing = [F.when(kind(p).isNull(), F.lit(f"missing {p}")) for p, t in params.items() if not t.endswith("?")]
        wrong = [F.when(~kind(p).rlike(f"^(?:{TYPES[t.rstrip('?')]})$"), F.lit(f"{p} is no {t.rstrip('?')}")) for p, t in params.items()]
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(args), F.array(*map(F.lit, params)) if params else none)), lambda k: F.concat(F.lit("unknown "), k))
        own = F.array_compact(F.array(*missing, *wrong)) if missing or wrong else none
        out = F.when(name == tool, F.concat(own, extra)).otherwise(out)
    return out


def levels(events: DataFrame) -> DataFrame:
    """Level of each call that uses others, or null where the uses run in a circle, and
    ``high``: the latest turn of what it waits for, calls and results.

    Calls that use one other are followed by pointer doubling to what their chain starts
    from, a call that uses none or several.  Then a round settles the calls of several uses
    whose uses are settled, until a round settles none: what is left is in a circle of uses
    or uses one.  Rounds follow the most calls of several uses in one chain; without uses
    there are none.  Uses of calls that don't exist are ignored, as are those of a call
    without an id.  A null conversation is one conversation.
    """
    spark = events.sparkSession
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    own = events.where("kind = 'call' AND call_id IS NOT NULL")
    held = events.where("kind <> 'message' AND call_id IS NOT NULL").select(key, F.col("call_id").alias("used"), "turn", (F.col("kind") == "call").alias("own"))
    calls = held.groupBy("conv", "used").agg(F.max("turn").alias("ready"), F.max("own").alias("own")).where("own").drop("own")
    uses = own.where("size(uses) > 0").select(key, "call_id", F.explode("uses").alias("used")).distinct()
    uses = cut(uses.join(calls, ["conv", "used"]))

    many = uses.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.first("used").alias("base"), F.max("ready").alias("high"))
    chain = cut(many.where("n = 1").select("conv", "call_id", "base", F.lit(1).cast("long").alias("hops"), "high"))
    several = cut(uses.join(many.where("n > 1").select("conv", "call_id"), ["conv", "call_id"], "left_semi"))
    inner = lambda df: df.join(df.select("conv", F.col("call_id").alias("base")), ["conv", "base"], "left_semi")
    # a chain without a circle has ended once the pointers span as many calls as there are
    span, n = 1, chain.count()
    while span < n and inner(chain).take(1):
        onward = chain.select("conv", F.col("call_id").alias("base"), F.col("base").alias("to"), F.col("hops").alias("more"), F.col("high").alias("higher"))
        longer = chain.join(onward, ["conv", "base"], "left")
        old, chain = chain, cut(longer.select("conv", "call_id", F.coalesce("to", "base").alias("base"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.greatest("high", "higher").alias("high")))
        tidy(spark, old)
        span *= 2

    # calls of several uses, by what their uses' chains start from
    via = chain.select("conv", F.col("call_id").alias("used"), "base", "hops", "high")
    left = cut(several.join(via, ["conv", "used"], "left").select("conv", "call_id", F.coalesce("base", "used").alias("base"), F.coalesce("hops", F.lit(0)).alias("hops"), F.greatest("ready", "high").alias("high")))
    users = uses.select("conv", "call_id").distinct()
    bases = left.select("conv", "base").unionByName(chain.select("conv", "base")).distinct()
    roots = bases.withColumnRenamed("base", "call_id").join(users, ["conv", "call_id"], "left_anti")
    done = cut(roots.withColumn("level", F.lit(0).cast("long")).withColumn("high", F.lit(None).cast("long")))
    at_base = lambda df: df.join(done.select("conv", F.col("call_id").alias("base"), F.col("level").alias("below"), F.col("high").alias("higher")), ["conv", "base"], "left")
    while left.take(1):
        known = at_base(left).groupBy("conv", "call_id").agg(F.max(F.col("below") + F.col("hops")).alias("top"), F.count("*").alias("all"), F.count("below").alias("met"), F.max(F.greatest("high", "higher")).alias("high"))
        ready = cut(known.where("all = met").select("conv", "call_id", (F.col("top") + 1).alias("level"), "high"))
        if not ready.take(1):
            break
        old = done, left, ready
        done, left = cut(done.unionByName(ready)), cut(left.join(ready, ["conv", "call_id"], "left_anti"))
        tidy(spark, *old)
    single = at_base(chain).select("conv", "call_id", (F.col("below") + F.col("hops")).alias("level"), F.greatest("high", "higher").alias("high"))
    circle = left.select("conv", "call_id").distinct().withColumn("level", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long"))
    out = done.where("level > 0").unionByName(single).unionByName(circle)
    return out.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "call_id", F.col("level").cast("int").alias("level"), "high", F.lit(True).alias("uses_calls"))


def link(events: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """One row an event: ``conv_id, position, turn, kind, call_id, linked, circular, faults, json``.

    ``linked``: a call with a result or a result with a call.  Several results of one call
    all link to it; repeated rows stay.  A null conversation is one conversation; null
    turns come first.  Events in a circle of uses come last and are marked.  An empty table
    gives no rows; other columns are ignored.
    """
    ends = events.where("kind <> 'message'").groupBy("conv_id", "call_id").agg(F.max(F.when(F.col("kind") == "call", F.struct("turn", "name"))).alias("call"), F.count_if(F.col("kind") == "result").alias("results"))
    e = events.alias("e")
    n = ends.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "call", "results")
    e = e.join(n.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    lv = levels(events).select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_li"), "level", "high", "uses_calls")
    e = e.join(lv, F.col("conv_id").eqNullSafe(F.col("_lc")) & (F.col("call_id") == F.col("_li")), "left")
    circular = F.coalesce(F.col("uses_calls") & F.col("level").isNull(), F.lit(False))
    level = F.when(circular, LAST).otherwise(F.coalesce("level", F.lit(0)))
    # a result waits for its call, and a call for what it uses
    place = F.when(F.col("kind") == "result", F.greatest("turn", F.col("call.turn"), "high")).otherwise(F.greatest("turn", "high"))
    linked = F.when(F.col("kind") == "call", F.col("results") > 0).when(F.col("kind") == "result", F.col("call").isNotNull())
    wrong = F.when(F.col("kind") == "call", faults(F.col("name"), F.col("arguments"), schemas))
    name = F.coalesce("name", F.when(F.col("kind") == "result", F.col("call.name")))
    body = F.to_json(F.struct(F.when(F.col("kind") == "call", F.col("arguments")).alias("arguments"), F.col("call_id"), F.col("content"), F.col("kind"), name.alias("name"), F.when(F.col("role") != "", F.col("role")).alias("role")))
    e = e.select("conv_id", "turn", "kind", "call_id", F.coalesce(linked, F.lit(False)).alias("linked"), circular.alias("circular"), wrong.alias("faults"), body.alias("json"), level.alias("level"), place.alias("place"))
    e = cut(e)
    after = F.when(F.col("kind") == "call", 0).when(F.col("kind") == "message", 1).otherwise(2)
    # null turns are dealt by their JSON's digest, the others by spans of places
    digest = F.md5(F.col("json").cast("binary"))
    bucket = F.struct(F.col("circular"), F.floor(F.col("place") / SPAN).alias("span"), F.when(F.col("place").isNull(), F.substring(digest, 1, 2)).alias("part"))
    order = [F.col("place").asc_nulls_first(), F.when(F.col("place").isNull(), digest), F.col("level"), after, F.col("turn"), F.col("call_id"), digest]
    e = running(e, ["conv_id"], bucket, order, F.lit(1).cast("long"), "position")
    return e.select("conv_id", "position", "turn", "kind", "call_id", "linked", "circular", "faults", "json")
