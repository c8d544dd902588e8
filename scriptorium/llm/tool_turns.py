"""A view of conversations in which assistants call tools, made from plain turns.

The given conversations hold no calls. Here every numbered assistant turn calls ``lookup`` and
``combine``, the second upon the first and upon the lookup of the turn before last, and
every user turn but the first of a conversation answers the lookup before it. A mark,
(characters + turn) % 8, decides which calls are faulty:

    0 a tool that is not listed     3 a parameter that is not listed   6 a call that waits for itself
    1 a parameter is missing        4 arguments that are no JSON       7 none
    2 a parameter of another type   5 a value that is not listed
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "lookup": {
        "type": "object",
        "properties": {"query": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "mode": {"enum": ["exact", "near"]}},
        "required": ["query"],
        "additionalProperties": False,
    },
    "combine": {
        "type": "object",
        "properties": {"parts": {"type": "array", "items": {"type": "string"}, "minItems": 2}},
        "required": ["parts"],
    },
}


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def tool_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of all turns, with calls in assistants' texts, and a result row for each answer.

    Null texts count as empty where a call holds them. Turns without a number
    and other roles stay as they are. Other columns than the four go.
    """
    turn, said = F.col("turn"), F.coalesce("text", F.lit(""))
    mark = F.pmod(F.length(said) + F.coalesce(turn, F.lit(0)), F.lit(8))
    faulty = [
        _object(turn=turn), _object(query=said, turn=turn.cast("string")), _object(query=said, turn=turn, extra=F.lit(True)),
        F.lit("no JSON"), _object(query=said, turn=turn, mode=F.lit("fast")),
    ]
    arguments = _object(turn=turn, query=said)
    for k, other in enumerate(faulty, 1):
        arguments = F.when(mark == k, other).otherwise(arguments)
    none = F.array().cast("array<string>")
    first, before = F.concat(F.lit("c"), turn.cast("string")), F.concat(F.lit("c"), (turn - 2).cast("string"))
    second = F.concat(F.lit("d"), turn.cast("string"))
    lookup = F.struct(
        first.alias("id"), F.when(mark == 0, "unlisted").otherwise("lookup").alias("name"), arguments.alias("arguments"), none.alias("depends_on")
    )
    combine = F.struct(
        second.alias("id"), F.lit("combine").alias("name"), _object(parts=F.array(first, before)).alias("arguments"),
        F.when(mark == 6, F.array(second)).otherwise(F.array(first, before)).alias("depends_on"),
    )
    called = _object(content=F.col("text"), tool_calls=F.array(lookup, combine))
    answer = _object(tool_call_id=F.concat(F.lit("c"), (turn - 1).cast("string")), content=said)
    turns = F.array(F.struct("role", F.when((F.col("role") == "assistant") & turn.isNotNull(), called).otherwise(F.col("text")).alias("text")))
    result = F.array(F.struct(F.lit("tool").alias("role"), answer.alias("text")))
    answers = (F.col("role") == "user") & (turn > 0)
    return conversations.select("conv_id", "turn", F.inline(F.when(answers, F.concat(turns, result)).otherwise(turns)))
