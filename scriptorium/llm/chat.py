"""Chat formatting with tool-call linking, in DataFrame operations only.

Input rows are turns (conv_id, turn, role, text). A text that is a JSON object with
``tool_calls`` (each with id, name, arguments and perhaps depends_on, or the nested
``function`` form) gives a message row and a row for each call; a turn of role
``tool`` gives a result row, linked by the ``tool_call_id`` of its JSON object.
Every other turn is a message row.

Calls and results are hash-joined by (conv_id, id). The order is topological: a call
after its message and after the results that it depends on, a result after its call.
It is given as a sortable key (order_turn, order_level, order_kind, order_index), found
by peeling calls whose dependencies are placed, so that no conversation has to be
gathered into one task. Arguments are validated against the tools' schemas and
serialised as canonical JSON: sorted keys, no blanks.

The text is parsed once for the links, which are ids and turns alone, and once for the
rows that come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, settle
from scriptorium.llm.json_schema import violations

_CALL = (
    "struct<id: string, name: string, arguments: string, depends_on: array<string>, "
    "function: struct<name: string, arguments: string>>"
)
_BODY = f"struct<content: string, tool_calls: array<{_CALL}>, tool_call_id: string>"
def _json(**fields: Column) -> Column:
    """Canonical JSON of an object: sorted keys, nulls kept."""
    parts = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def _same_call(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["__conv"]) & (a["call_id"] == b["__call"])


def _placed(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_level, cyclic) of each identified call.

    Peels calls whose dependencies have their place, a join a level; what is left at
    the end depends on itself and is placed by its turn.
    """
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "index", "needs")).alias("x"))
    known = first.select("conv_id", "call_id", "x.turn", F.col("x.needs").alias("needs"))
    wants = known.select("conv_id", F.col("call_id").alias("of"), F.explode("needs").alias("call_id")).distinct()
    ids = known.select(F.col("conv_id").alias("__conv"), F.col("call_id").alias("__call"))
    wants = checkpointed(wants.join(ids, _same_call(wants, ids), "left_semi"))  # only calls that exist can hold one up
    counts = wants.groupBy("conv_id", F.col("of").alias("call_id")).agg(F.count(F.lit(1)).alias("left"))
    b = counts.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
    state = known.join(b, _same_call(known, b), "left").select(
        "conv_id", "call_id", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.coalesce("left", F.lit(0)).alias("left")
    )
    placed = checkpointed(state.where("left = 0").drop("left"))
    waiting = checkpointed(state.where("left > 0"))
    newest = placed
    got = None  # what each waiting call has heard of so far
    while not waiting.isEmpty() and not newest.isEmpty():
        n = newest.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
        heard = wants.join(n, _same_call(wants, n)).select(
            "conv_id", F.col("of").alias("call_id"), F.struct("order_turn", (F.col("order_level") + 1).alias("order_level")).alias("at")
        )
        heard = heard.groupBy("conv_id", "call_id").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
        if got is not None:
            heard = got.unionByName(heard).groupBy("conv_id", "call_id").agg(F.max("at").alias("at"), F.sum("n").alias("n"))
        got = checkpointed(heard)
        h = got.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
        met = waiting.join(h, _same_call(waiting, h))
        own = F.struct("order_turn", "order_level")
        ready = met.where(F.col("n") == F.col("left")).select("conv_id", "call_id", F.when(own > F.col("at"), own).otherwise(F.col("at")).alias("at"))
        newest = checkpointed(ready.select("conv_id", "call_id", "at.order_turn", "at.order_level"))
        placed = checkpointed(placed.unionByName(newest))
        r = newest.select(F.col("conv_id").alias("__conv"), F.col("call_id").alias("__call"))
        waiting = checkpointed(waiting.join(r, _same_call(waiting, r), "left_anti"))
    stuck = waiting.drop("left").withColumn("cyclic", F.lit(True))
    return placed.withColumn("cyclic", F.lit(False)).unionByName(stuck)


def format_chat(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Message, call and result rows of all conversations, with order keys and canonical JSON.

    Columns: conv_id, turn, role, kind, call_id, name, status, problems, order_turn,
    order_level, order_kind, order_index, json. ``status`` is ``message``; ``answered``,
    ``unanswered``, ``duplicate`` (an id used again: the earliest call keeps the links)
    or ``unnamed`` for calls; ``linked`` or ``orphan`` for results. ``problems`` lists
    what validation found, and is null for rows that are no call; without ``schemas``
    only malformed arguments are reported, with them also unknown tools and what
    ``json_schema.violations`` finds; a schema keyword that it does not read is a
    ValueError. A text that
    is no JSON object is content as it stands; null text is null content. Repeated
    rows stay repeated. Null conv_ids are one conversation.
    """
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", _BODY))
    base = turns.select("conv_id", "turn", "role", "text").withColumn("body", body)
    is_result = F.coalesce(F.col("role") == "tool", F.lit(False))
    has_calls = F.coalesce(F.size("body.tool_calls") > 0, F.lit(False)) & ~is_result
    messages = base.where(~is_result).select(
        "conv_id", "turn", "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit("message").alias("status"), F.lit(None).cast("array<string>").alias("problems"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.lit(0).alias("order_kind"), F.lit(0).alias("order_index"),
        _json(content=F.when(has_calls, F.col("body.content")).otherwise(F.col("text")), role=F.col("role")).alias("json"),
    )
    exploded = base.where(has_calls).select("conv_id", "turn", "role", F.posexplode("body.tool_calls").alias("index", "c"))
    raw = F.coalesce("c.arguments", "c.function.arguments", F.lit("{}"))
    calls = exploded.select(
        "conv_id", "turn", "role", "index", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"),
        raw.alias("raw"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("needs"),
    )
    results = base.where(is_result).select(
        "conv_id", "turn", "role", F.col("body.tool_call_id").alias("call_id"),
        F.when(F.col("body.tool_call_id").isNotNull(), F.col("body.content")).otherwise(F.col("text")).alias("content"),
    )
    links = settle(calls.select("conv_id", "turn", "index", "call_id", "needs"), "chat-calls")
    replies = settle(results.select("conv_id", "call_id"), "chat-results")
    if links.isEmpty() and replies.isEmpty():  # nothing to link: the joins would only move empty tables
        return messages
    places = checkpointed(_placed(links))
    firsts = links.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "index")).alias("first"))
    answers = replies.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("answers"))
    p = places.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
    f = firsts.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
    a = answers.withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
    called = calls.join(p, _same_call(calls, p), "left").drop("__conv", "__call")
    called = called.join(f, _same_call(called, f), "left").drop("__conv", "__call")
    called = called.join(a, _same_call(called, a), "left").drop("__conv", "__call")
    variant = F.try_parse_json("raw")
    broken = variant.isNull() | ~F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    checked = F.array().cast("array<string>")
    if schemas is not None:
        checked = F.array(F.lit("unknown_tool"))
        for tool, schema in schemas.items():
            checked = F.when(F.col("name") == tool, violations(schema, variant)).otherwise(checked)
    cyclic = F.when(F.coalesce("cyclic", F.lit(False)), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    again = F.struct("turn", "index") > F.col("first")
    status = (
        F.when(F.col("call_id").isNull(), "unnamed").when(again, "duplicate").when(F.col("answers").isNotNull(), "answered").otherwise("unanswered")
    )
    call_rows = called.select(
        "conv_id", "turn", "role", F.lit("call").alias("kind"), "call_id", "name", status.alias("status"),
        F.concat(F.when(broken, F.array(F.lit("arguments"))).otherwise(checked), cyclic).alias("problems"),
        F.when(again, F.col("turn")).otherwise(F.coalesce("order_turn", "turn")).alias("order_turn"),
        F.when(again, F.lit(0)).otherwise(F.coalesce("order_level", F.lit(0))).alias("order_level"),
        F.lit(1).alias("order_kind"), F.col("index").alias("order_index"),
        F.when(
            broken, _json(arguments=F.col("raw"), id=F.col("call_id"), name=F.col("name"), role=F.col("role"), type=F.lit("tool_call"))
        ).otherwise(_json(arguments=variant, id=F.col("call_id"), name=F.col("name"), role=F.col("role"), type=F.lit("tool_call"))).alias("json"),
    )
    linked = results.join(p, _same_call(results, p), "left")
    after = F.struct(F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"))
    call_at = F.struct("order_turn", "order_level")
    at = F.when(F.col("__call").isNull() | (after > call_at), after).otherwise(call_at)
    result_rows = linked.select(
        "conv_id", "turn", "role", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"),
        F.when(F.col("__call").isNull(), "orphan").otherwise("linked").alias("status"), F.lit(None).cast("array<string>").alias("problems"),
        at["order_turn"].alias("order_turn"), at["order_level"].alias("order_level"), F.lit(2).alias("order_kind"), F.lit(0).alias("order_index"),
        _json(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("call_id")).alias("json"),
    )
    return messages.unionByName(call_rows).unionByName(result_rows)


ORDER = ["conv_id", "order_turn", "order_level", "order_kind", "order_index"]


def write_chat(turns: DataFrame, folder: str, schemas: dict[str, dict] | None = None) -> None:
    """JSON lines in conversation order: files in name order hold ascending order keys."""
    rows = format_chat(turns, schemas).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows.select(F.col("json").alias("value")).write.text(folder)
