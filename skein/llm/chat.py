"""Tool-call linking: calls meet their results, arguments meet their schemas, messages become canonical JSON.

An assistant message may be a JSON object with `tool_calls`, a list of objects with
`id`, `name`, `arguments` (an object) and perhaps `after`, ids of calls whose results
it needs. A message of role `tool` is a JSON object with `tool_call_id` and `content`.
Any other text is a message as it stands. Calls and results are joined on the
conversation and the id. Messages stand in the order of their turns, but a result
stands with its call, and calls of one message stand by how long a chain of others
they wait for (`level`).

A call is valid if its arguments are an object that has the required names and whose
values have the types of its tool's schema: `string`, `integer`, `number`, `boolean`,
`array`, `object` or `null`. `problem` says what is wrong: `duplicate id`, `cycle`,
`unknown call awaited`, `unknown tool`, `not an object`, `missing argument`, `unknown
argument`, `wrong type`, the first of these that holds; for results `no call` or `second
result`. A call without a result has a null result_turn.

One row comes out for each message, call and result, so that a conversation of any
length is never gathered in one place. A message with calls has a row of its own, with
what it holds beside `tool_calls` and with its turn's role, if it holds more than that
or its list of calls is empty; otherwise its calls' rows say all of it. Rows stand in
the order of (conv_id, order_turn, order_call, order_kind, turn). Canonical JSON has its names in order and no
white space, at every depth.

Edge cases: a null or empty text is a message with empty content; text that is not
JSON is a message; of calls with one id in a conversation the first in order counts,
the others are `duplicate id`; of results for one call the first; a call without an id
has no result and waits for what it names; rows without a conversation are one, sorted
first, as are those without a turn; rows of one conversation and turn stand in the order
of a 64-bit hash of role and text; repeated rows are messages of their own, so that the
second one's calls and results are duplicates; an empty table gives no rows; extra
columns are not read.

`from_turns` writes the turns of a plain chat as calls and results, so that chats
without tools go through the same linking.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize

#: Copies of one message that a task writes out.
_COPIES = 10_000
#: Rounds of settled calls that one plan unites.
_PLAN = 16


def tool_schemas(spark: SparkSession, tools: dict[str, dict[str, str]], required: dict[str, list[str]]) -> DataFrame:
    """tool, argument, kind and needed, a row for each argument; a tool without arguments has one row of nulls."""
    rows = [(t, a, kind, a in required.get(t, [])) for t, args in tools.items() for a, kind in args.items()]
    rows += [(t, None, None, None) for t, args in tools.items() if not args]
    return spark.createDataFrame(rows, "tool string, argument string, kind string, needed boolean")


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") & name.endswith(",0)"), "integer").when(name.startswith("DECIMAL") | (name == "DOUBLE") | (name == "FLOAT"), "number")
        .when(name.startswith("ARRAY"), "array").otherwise("object")
    )


def _read(own: DataFrame) -> DataFrame:
    """own with the parsed JSON where the role and its form call for it: `v`, and of it the calls of an assistant and the call that a tool answers."""
    parsed = F.when(F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim("text"), F.lit("{")), F.try_parse_json("text"))
    own = own.withColumn("v", parsed)
    # a part of the wrong type reads as null
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    return own.withColumn("calls", F.when(F.col("role") == "assistant", calls)).withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls, and what _read finds."""
    return _read(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))


def told_apart(own: DataFrame) -> DataFrame:
    """The messages with calls or results, with `conv` (a struct, equal where the conversation is null) and `spot`, which orders and names all messages of a conversation.

    Repeated rows are counted and written out again under numbers, a part at a time.
    """
    linked = own.where("calls is not null or result_of is not null")
    once = linked.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    parts = once.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _COPIES))))
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * _COPIES, F.least("times", (F.col("part") + 1) * _COPIES) - 1)))
    named = copies.select("conv_id", "turn", "role", "text", F.struct("conv_id").alias("conv"), F.struct("turn", F.xxhash64("role", "text").alias("row"), "copy").alias("spot"))
    return _read(named)


def calls_of(own: DataFrame) -> DataFrame:
    """A row for each call, with its arguments and what it waits for; `item` names it."""
    apart = own.where("calls is not null").select("conv", "conv_id", "turn", "spot", F.posexplode("calls").alias("call_no", "c"))
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    item = F.struct("conv", "spot", "call_no").alias("item")
    return apart.select(item, "conv", "conv_id", "turn", F.struct("spot", "call_no").alias("place"), "call_no", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("tool"), get("$.arguments", "variant").alias("arguments"), get("$.after", "array<string>").alias("after"))


def _led_back(waits: DataFrame) -> DataFrame:
    """Calls that wait for one call alone, led back to the first (`at`) that is not such a call, `far` steps away; those on or behind a cycle of such calls are left out.

    Every round doubles the steps. When as many calls as in the round before were led on,
    none of those came to an end, and none will.
    """
    one = waits.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.min("needs").alias("at")).where("n = 1")
    now, before = materialize(one.select("conv", "call_id", "at", F.lit(1).cast("long").alias("far"), F.lit(True).alias("led"))), -1
    while True:
        on = now.select("conv", F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("far").alias("more"))
        met = now.join(on, ["conv", "at"], "left")
        now = materialize(met.select("conv", "call_id", F.coalesce("to", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("to").isNotNull().alias("led")))
        if (n := now.where("led").count()) in (0, before):
            return now.where("not led").drop("led")
        before = n


def levels(calls: DataFrame) -> DataFrame:
    """conv, call_id and level of first calls: the longest chain of calls waited for; those on or behind a cycle have none.

    Calls that wait for one call alone take their level from where they are led back to.
    Those that wait for several are settled in rounds, each met by what the round before
    has settled, so that there are as many rounds as the longest chain has calls of this kind.
    """
    waits = calls.where("after is not null").select("conv", "call_id", F.explode(F.array_distinct("after")).alias("needs"))
    known = calls.select("conv", "call_id").distinct()
    waits = materialize(waits.join(known.select("conv", F.col("call_id").alias("needs")), ["conv", "needs"], "left_semi"))
    if waits.isEmpty():
        return known.withColumn("level", F.lit(0))
    back = _led_back(waits)
    settled = fresh = materialize(known.join(waits, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    several = waits.groupBy("conv", "call_id").agg(F.count("*").alias("left")).where("`left` > 1")
    waiting = materialize(several.withColumn("most", F.lit(0).cast("long")))
    ends = back.select("conv", F.col("call_id").alias("needs"), "at", "far")
    routes = materialize(waits.join(waiting.select("conv", "call_id"), ["conv", "call_id"], "left_semi").join(ends, ["conv", "needs"], "left").select("conv", "call_id", F.coalesce("at", "needs").alias("at"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    rounds = 0
    while not fresh.isEmpty():
        met = routes.join(fresh.select("conv", F.col("call_id").alias("at"), "level"), ["conv", "at"]).groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("far")).alias("reached"))
        waiting = materialize(waiting.where("`left` > 0").join(met, ["conv", "call_id"], "left").select("conv", "call_id", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("most", "reached").alias("most")))
        fresh = waiting.where("`left` = 0").select("conv", "call_id", F.col("most").alias("level"))
        settled, rounds = settled.unionByName(fresh), rounds + 1
        if rounds % _PLAN == 0:
            settled = materialize(settled)
    behind = back.join(settled.select("conv", F.col("call_id").alias("at"), "level"), ["conv", "at"]).select("conv", "call_id", (F.col("level") + F.col("far")).alias("level"))
    return settled.unionByName(behind).withColumn("level", F.col("level").cast("int"))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per call, named by `item`, the first problem of its tool and arguments, or null."""
    tools = schemas.select("tool").distinct().withColumn("known", F.lit(True))
    given = calls.where(_kind(F.col("arguments")) == "object").select("item", "tool", F.explode(F.map_entries(F.try_variant_get("arguments", "$", "map<string,variant>"))).alias("e"))
    given = given.select("item", "tool", F.col("e.key").alias("argument"), _kind(F.col("e.value")).alias("found"))
    args = schemas.where("argument is not null")
    judged = given.join(args, ["tool", "argument"], "left")
    fits = (F.col("found") == F.col("kind")) | ((F.col("kind") == "number") & (F.col("found") == "integer"))
    wrong = judged.groupBy("item").agg(F.max(F.col("kind").isNull()).alias("unknown"), F.max(F.col("kind").isNotNull() & ~fits).alias("mistyped"), F.count_if(F.col("needed")).alias("had"))
    needed = args.where("needed").groupBy("tool").agg(F.count("*").alias("need"))
    joined = calls.join(tools, "tool", "left").join(needed, "tool", "left").join(wrong, "item", "left")
    problem = (
        F.when(F.col("known").isNull(), "unknown tool").when(F.col("arguments").isNull() | (_kind(F.col("arguments")) != "object"), "not an object")
        .when(F.coalesce("need", F.lit(0)) > F.coalesce("had", F.lit(0)), "missing argument").when(F.col("unknown"), "unknown argument").when(F.col("mistyped"), "wrong type")
    )
    return joined.select("item", problem.alias("schema_problem"))


def _lost(calls: DataFrame, known: DataFrame) -> DataFrame:
    """The items of calls that wait for an id which no call of their conversation has."""
    waits = calls.select("item", "conv", F.explode("after").alias("call_id"))
    return waits.join(known.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti").select("item").distinct().withColumn("lost", F.lit(True))


def _no_call() -> list[Column]:
    """The columns of a message's row that only calls and results fill."""
    empty = (F.lit(None).cast(t).alias(c) for c, t in (("call_no", "int"), ("call_id", "string"), ("call_turn", "bigint"), ("result_turn", "bigint")))
    return [F.lit("message").alias("kind"), *empty, F.lit(0).alias("level"), F.lit(None).cast("string").alias("problem")]


def ordered(rows: DataFrame) -> DataFrame:
    """rows with order_call (-1 without a call, else by level, then call_no) and order_kind (message, call, result)."""
    call = F.coalesce(F.shiftleft(F.col("level").cast("long"), 32) + F.col("call_no"), F.lit(-1).cast("long"))
    kind = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    return rows.withColumn("order_call", call).withColumn("order_kind", kind)


def _quoted(text: Column) -> Column:
    """A string as JSON; null for null."""
    wrapped = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def _body(**parts: Column) -> Column:
    """A JSON object of parts that are JSON already, in the order of their names."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(k) + ":"), parts[k]) for k in sorted(parts))), F.lit("}"))


def link(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each message, call and result: conv_id, turn, kind, call_no, call_id, call_turn, result_turn, level, problem, json and the order columns; sorted by (conv_id, order_turn, order_call, order_kind, turn)."""
    all_ = messages(conversations)
    plain = all_.where("calls is null and result_of is null").select("conv_id", "turn", *_no_call(), F.col("turn").alias("order_turn"), _body(content=_quoted(F.col("text")), role=_quoted(F.col("role"))).alias("json"))
    rest = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.isin("tool_calls", "role"))
    beside = all_.where("calls is not null").withColumn("rest", rest).where("size(rest) > 0 or size(calls) = 0")
    whole = F.to_json(F.to_variant_object(F.map_concat("rest", F.create_map(F.lit("role"), F.col("role").cast("variant")))))
    beside = beside.select("conv_id", "turn", *_no_call(), F.col("turn").alias("order_turn"), whole.alias("json"))
    own = told_apart(all_)
    calls = materialize(calls_of(own))
    results = materialize(own.where("result_of is not null").select("conv", "conv_id", "turn", "spot", F.col("result_of").alias("call_id"), F.coalesce(F.to_json(F.try_variant_get("v", "$.content", "variant")), F.lit("null")).alias("content")))
    # what calls and results are joined to is written first, so that a join of a hot key can be split
    first_call = materialize(calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("place", "turn")).alias("first")))
    first_result = materialize(results.groupBy("conv", "call_id").agg(F.min(F.struct("spot", "turn")).alias("answer")))
    headed = materialize(calls.join(first_call, ["conv", "call_id"], "left").withColumn("second", F.coalesce(F.col("place") != F.col("first.place"), F.lit(False))))
    leading = headed.where("call_id is not null and not second")
    level = levels(leading)
    made = headed.join(first_result, ["conv", "call_id"], "left").join(level, ["conv", "call_id"], "left").join(checked(calls, schemas), "item", "left").join(_lost(headed.where("not second"), first_call), "item", "left")
    problem = F.when(F.col("second"), "duplicate id").when(F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle").when(F.col("lost"), "unknown call awaited").otherwise(F.col("schema_problem"))
    json_call = _body(arguments=F.coalesce(F.to_json("arguments"), F.lit("null")), id=_quoted(F.col("call_id")), name=_quoted(F.col("tool")), role=F.lit('"assistant"'))
    call_rows = made.select("conv_id", "turn", F.lit("call").alias("kind"), "call_no", "call_id", F.coalesce("first.turn", "turn").alias("call_turn"), F.when(~F.col("second"), F.col("answer.turn")).alias("result_turn"), F.coalesce("level", F.lit(0)).alias("level"), problem.alias("problem"), F.col("turn").alias("order_turn"), json_call.alias("json"))
    met = results.join(first_call, ["conv", "call_id"], "left").join(first_result, ["conv", "call_id"], "left").join(level, ["conv", "call_id"], "left")
    fault = F.when(F.col("first").isNull(), "no call").when(F.col("spot") != F.col("answer.spot"), "second result")
    known = F.col("first").isNotNull()
    json_result = _body(content=F.col("content"), role=F.lit('"tool"'), tool_call_id=_quoted(F.col("call_id")))
    result_rows = met.select("conv_id", "turn", F.lit("result").alias("kind"), F.col("first.place.call_no").alias("call_no"), "call_id", F.col("first.turn").alias("call_turn"), F.col("answer.turn").alias("result_turn"), F.coalesce("level", F.lit(0)).alias("level"), fault.alias("problem"), F.when(known, F.col("first.turn")).otherwise(F.col("turn")).alias("order_turn"), json_result.alias("json"))
    return ordered(plain.unionByName(beside).unionByName(call_rows).unionByName(result_rows))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain chats as calls and results: what a user says is put to tools line by line, and the assistant's next turn is a result.

    Line i of a user's turn t is call `t<t>.<i>`, but every fifth line repeats the id
    before it. With n the line's length, n mod 4 chooses search, calculator, weather or
    `lookup`, which no schema has; where 5 divides n the arguments are faulty, where 3
    does search has its limit as a string. A line waits for the one before it unless 4
    divides i, and where 7 divides n also for the next one, there or not. An assistant's
    turn u of length n answers `t<u - 1>.<n mod 2>`. Other turns stay as they are.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn, i: F.concat(F.lit("t"), turn.cast("string"), F.lit("."), i.cast("string"))

    def call(x: Column, i: Column) -> Column:
        n = F.length(x)
        faulty, said = n % 5 == 0, _quoted(x)
        limit = F.when(n % 3 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
        search = F.concat(F.lit('{"limit":'), limit, F.when(~faulty, F.concat(F.lit(',"query":'), said)).otherwise(""), F.lit("}"))
        calculator = F.concat(F.lit('{"expression":'), said, F.when(faulty, ',"more":1').otherwise(""), F.lit("}"))
        weather = F.when(faulty, "[1]").otherwise(F.concat(F.lit('{"place":'), said, F.lit(',"days":'), n, F.lit(',"metric":true}')))
        arguments = F.when(n % 4 == 0, search).when(n % 4 == 1, calculator).when(n % 4 == 2, weather).otherwise(F.concat(F.lit('{"key":'), said, F.lit("}")))
        tool = F.element_at(F.array(*(F.lit(t) for t in ("search", "calculator", "weather", "lookup"))), n % 4 + 1)
        after = F.to_json(F.array_compact(F.array(F.when(i % 4 != 0, name(F.col("turn"), i - 1)), F.when(n % 7 == 0, name(F.col("turn"), i + 1)))))
        own_id = name(F.col("turn"), F.when(i % 5 == 4, i - 1).otherwise(i))
        return F.concat(F.lit('{"id":"'), own_id, F.lit('","name":"'), tool, F.lit('","arguments":'), arguments, F.lit(',"after":'), after, F.lit("}"))

    asked = F.concat(F.lit('{"tool_calls":['), F.array_join(F.transform(F.split("text", "\n"), call), ","), F.lit("]}"))
    answered = F.concat(F.lit('{"tool_call_id":"'), name(F.col("turn") - 1, F.length("text") % 2), F.lit('","content":'), _quoted(F.col("text")), F.lit("}"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return own.select("conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(user & F.col("turn").isNotNull(), asked).when(assistant & F.col("turn").isNotNull(), answered).otherwise(F.col("text")).alias("text"))


#: Tools that conversations may call, with their arguments, and the arguments that must be there.
TOOLS = {"search": {"query": "string", "limit": "integer"}, "calculator": {"expression": "string"}, "weather": {"place": "string", "days": "integer", "metric": "boolean"}}
REQUIRED = {"search": ["query"], "calculator": ["expression"], "weather": ["place"]}
