"""Chat formatting: linking, order, validation, canonical JSON."""

import collections
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.chat import ORDER, format_chat, write_chat
from scriptorium.llm.common import read_table
from scriptorium.llm.json_schema import violations
from scriptorium.llm.registry import ORACLE_SQL, QUERIES

SCHEMAS = {
    "search": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q"], "additionalProperties": False},
    "sum": {"properties": {"xs": {"type": "array"}, "ok": {"type": "boolean"}, "x": {"type": "number"}}, "required": ["xs"]},
}


def call(i, name="search", arguments=None, **more):
    return {"id": i, "name": name, "arguments": {"q": "a"} if arguments is None else arguments, **more}


def assistant(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


@pytest.fixture
def chat(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, json string")

    return make


def ordered(df):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, x) for x in (r[c] for c in ORDER)))


def test_links_and_order(chat):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("b")), (1, 2, "assistant", assistant(call("b", depends_on=["a"]), call("a"), content="two")),
        (1, 3, "tool", result("a")), (1, 4, "tool", result("zzz")), (1, 5, "tool", "no json"),
        (1, 6, "assistant", assistant(call("c"), call("a"), call(None))), (2, 0, "tool", result("a")),
    ]
    got = ordered(format_chat(chat(rows), SCHEMAS))
    assert len(got) == 2 + 3 + 2 + 4 + 2
    at = {(r.kind, r.call_id, r.turn): k for k, r in enumerate(got) if r.conv_id == 1}
    assert at["call", "a", 2] < at["call", "b", 2] < at["result", "b", 1]
    assert at["call", "a", 2] < at["result", "a", 3]
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in got}
    assert status[1, "call", "a", 2] == status[1, "call", "b", 2] == "answered"
    assert status[1, "call", "c", 6] == "unanswered" and status[1, "call", "a", 6] == "duplicate" and status[1, "call", None, 6] == "unnamed"
    assert status[1, "result", "zzz", 4] == status[1, "result", None, 5] == status[2, "result", "a", 0] == "orphan"
    assert status[1, "result", "b", 1] == "linked"


def test_chains_and_cycles(chat):
    chain = [(1, 0, "assistant", assistant(*(call(f"k{i}", depends_on=[f"k{i + 1}"] if i < 6 else ["unknown"]) for i in range(7))))]
    loop = [(2, 0, "assistant", assistant(call("x", depends_on=["y"]), call("y", depends_on=["x"]), call("z", depends_on=["y"]), call("w")))]
    got = ordered(format_chat(chat(chain + loop)))
    assert [r.call_id for r in got if r.conv_id == 1 and r.kind == "call"] == [f"k{i}" for i in range(6, -1, -1)]
    assert {r.call_id: r.problems for r in got if r.conv_id == 2 and r.kind == "call"} == {"x": ["cycle"], "y": ["cycle"], "z": ["cycle"], "w": []}


def test_validation_and_canonical_json(chat):
    cases = [
        (call("1", arguments={"q": "é\"\n", "n": 3}), []), (call("2", arguments={"n": "3"}), ["missing:q", "type:n"]),
        (call("3", arguments={"q": "a", "z": 1, "b": 2}), ["unknown:b", "unknown:z"]), (call("4", "nothing"), ["unknown_tool"]),
        (call("5", arguments="not json"), ["arguments"]), (call("6", "sum", {"xs": [1, {"b": 1, "a": None}], "x": 1.5, "ok": True}), []),
        (call("7", "sum", {"xs": {}, "x": "1"}), ["type:x", "type:xs"]), (call("8", arguments=json.dumps({"q": "as text"})), []),
        ({"id": "9", "type": "function", "function": {"name": "search", "arguments": "{\"q\": 1}"}}, ["type:q"]), (call("10", arguments=[1]), ["arguments"]),
    ]
    got = {r.call_id: r for r in format_chat(chat([(1, 0, "assistant", assistant(*(c for c, _ in cases)))]), SCHEMAS).where("kind = 'call'").collect()}
    for c, want in cases:
        row = got[c["id"]]
        assert sorted(row.problems) == want, c
        assert row.json == json.dumps(json.loads(row.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got["6"].json)["arguments"] == {"xs": [1, {"a": None, "b": 1}], "x": 1.5, "ok": True}
    assert json.loads(got["5"].json)["arguments"] == "not json"
    without = format_chat(chat([(1, 0, "assistant", assistant(call("4", "nothing")))])).where("kind = 'call'").first()
    assert without.problems == []


def test_odd_rows(chat, spark, tmp_path):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "assistant", "{broken"), (None, 3, "assistant", assistant(call("n"))),
            (None, 4, "tool", result("n")), (2, 1, "assistant", "x" * 300000), (2, 2, "assistant", "{\"a\": 1}")]
    got = format_chat(chat(rows)).collect()
    assert len(got) == 9 and {r.status for r in got if r.conv_id is None and r.kind != "message"} == {"answered", "linked"}
    assert sorted(r.json for r in got if r.conv_id == 1)[0] == '{"content":"","role":"user"}'
    assert '{"content":null,"role":null}' in {r.json for r in got}
    assert json.loads(next(r.json for r in got if r.turn == 2))["content"] == "{\"a\": 1}"
    assert format_chat(chat([]) if False else chat(rows).limit(0)).count() == 0
    write_chat(chat(rows), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 9


def test_table(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    got = {(r.conv_id, r.turn): json.loads(r.json) for r in format_chat(turns).collect()}
    assert got == {(r.conv_id, r.turn): {"role": r.role, "content": r.text} for r in turns.collect()}


def test_no_python_in_the_plan(chat):
    plan = format_chat(chat([(1, 0, "assistant", assistant(call("a"))), (1, 1, "tool", result("a"))]), SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_tool_turns_against_sql(spark, sf_dir, tmp_path):
    rows = [
        (None, 0, "assistant", "a"), (None, 1, "user", None), (None, 2, "assistant", None), (7, None, "assistant", "b"), (7, None, "user", "c"),
        (7, 3, "user", "answers nobody"), (8, 1, "assistant", "fiveo"), (8, 1, "assistant", "six six"), (8, 2, "user", "\"q\"\\"), (8, 2, "user", "x"),
        (9, 1, "assistant", "fiveo"), (9, 2, None, "null role"), (9, 3, "system", "é" * 70000),
    ]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string")
    odd.write.parquet(f"{tmp_path}/odd/conversations.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    for folder, path in ((sf_dir, "conversations.parquet"), (f"{tmp_path}/odd", "conversations.parquet/*.parquet"), (f"{tmp_path}/none", "conversations.parquet/*.parquet")):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/{path}'")
        got = QUERIES["op10_chat_formatting"](spark, folder)
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op10_chat_formatting']})").fetchall()
        mine, theirs = (collections.Counter(map(tuple, x)) for x in (got.collect(), want))
        assert not mine - theirs and not theirs - mine


def test_schema_keywords(spark):
    cases = [
        ({"type": ["string", "null"]}, [('"a"', []), ("null", []), ("1", ["type:"])]),
        ({"type": "integer"}, [("1.0", []), ("1.5", ["type:"]), ("true", ["type:"])]),
        ({"enum": ["a", 1, [1, {"b": None}]]}, [('"a"', []), ("1.0", []), ('[1,{"b":null}]', []), ('"1"', ["enum:"])]),
        ({"const": None}, [("null", []), ("0", ["const:"])]),
        ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.5}, [("1", []), ("2.5", []), ("3", ["exclusiveMaximum:"]), ("0.7", ["minimum:", "multipleOf:"]), ('"x"', [])]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, [('"ab"', []), ('"a"', ["minLength:"]), ('"bbbb"', ["maxLength:", "pattern:"]), ("5", [])]),
        ({"items": {"type": "string"}, "minItems": 1, "uniqueItems": True}, [('["a"]', []), ("[]", ["minItems:"]), ('["a","a",1,2]', ["uniqueItems:", "type:[]"]), ("{}", [])]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, [('"a"', []), ("6", []), ("4", ["anyOf:"])]),
        ({"oneOf": [{"minimum": 1}, {"maximum": 3}], "not": {"const": 0}}, [("5", []), ("2", ["oneOf:"]), ("0", ["not:"])]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [("2", []), ("4", ["allOf:"])]),
        (
            {"properties": {"a": {"properties": {"b": {"type": "array", "items": {"required": ["c"]}}}, "required": ["b"]}}, "additionalProperties": {"type": "number"}},
            [('{"a":{"b":[{"c":1}]},"z":2}', []), ('{"a":{}}', ["missing:a.b"]), ('{"a":{"b":[{"c":1},{},{}]}}', ["missing:a.b[].c"]), ('{"z":"q"}', ["type:*"]), ('{"a":null}', [])],
        ),
        ({"properties": {"a": {"type": "string"}}, "additionalProperties": False, "minProperties": 1}, [('{"b":1}', ["unknown:b"]), ("{}", ["minProperties:"]), ('{"a":null}', ["type:a"]), ('{"a":"x"}', [])]),
        (False, [("1", ["false:"])]), (True, [("1", [])]), ({"title": "any"}, [("[]", [])]),
    ]
    for schema, values in cases:
        df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(values)], "k int, v string")
        got = [r.found for r in df.select("k", violations(schema, F.try_parse_json("v")).alias("found")).orderBy("k").collect()]
        assert got == [want for _, want in values], schema
    with pytest.raises(ValueError):
        violations({"$ref": "#/x"}, F.lit(None))
    with pytest.raises(ValueError):
        violations({"type": "text"}, F.lit(None))
