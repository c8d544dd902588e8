"""JSON Schema as DataFrame expressions over a variant.

A schema is known when the plan is built, so it becomes an expression that lists what a
value violates: no table of rules, no join, no Python in tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.llm.common import let

# JSON Schema's type names, and the variant types that they admit.
TYPES = {
    "string": "^STRING$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*$", "object": "^OBJECT.*$", "null": "^VOID$",
}
# Keywords that say nothing about validity.
ANNOTATIONS = {
    "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment",
}
READ = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
    "pattern", "items", "minItems", "maxItems", "uniqueItems", "properties", "required", "additionalProperties", "minProperties",
    "maxProperties", "anyOf", "oneOf", "allOf", "not",
}


def _is(value: Column, kind: str) -> Column:
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return _is(value, "number") & (number == F.floor(number))
    if kind not in TYPES:
        raise ValueError(f"unknown type in a schema: {kind!r}")
    return F.coalesce(F.regexp_like(F.schema_of_variant(value), F.lit(TYPES[kind])), F.lit(False))


def _equals(value: Column, wanted) -> Column:
    """Numbers by value, all else by canonical JSON."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return _is(value, "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    text = json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.coalesce(F.to_json(value) == text, F.lit(False))


def _report(bad: Column, keyword: str, path: str) -> Column:
    """One entry if the condition holds, none if it does not or can't be told."""
    return F.when(bad, F.array(F.lit(f"{keyword}:{path}"))).otherwise(F.array().cast("array<string>"))


def violations(schema: dict | bool, value: Column, path: str = "") -> Column:
    """``keyword:path`` of all that the variant ``value`` violates; empty if it is valid.

    A path names properties joined by dots; ``[]`` stands for any item of an array, and
    what several items violate alike is one entry. Missing and unknown properties are
    ``missing`` and ``unknown``. As in JSON Schema, a keyword for another type than the
    value's does not apply, and a number without a fraction is an integer. Patterns are
    Java's. Keywords that are neither read nor annotations are a ValueError.
    """
    if isinstance(schema, bool):
        return _report(F.lit(not schema), "false", path)
    unread = set(schema) - READ - ANNOTATIONS
    if unread:
        raise ValueError(f"schema keywords that are not read: {sorted(unread)}")
    found = []

    def when(keyword: str, bad) -> None:
        if keyword in schema:
            found.append(_report(bad(schema[keyword]), keyword, path))

    def any_of(conditions: list[Column], start: bool) -> Column:
        out = F.lit(start)
        for c in conditions:
            out = out | c
        return out

    def valid(part) -> Column:
        return F.size(violations(part, value, path)) == 0

    number = F.try_variant_get(value, "$", "double")
    numeric = _is(value, "number")
    kinds = schema.get("type", [])
    when("type", lambda _: ~any_of([_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)], False))
    when("enum", lambda options: ~any_of([_equals(value, o) for o in options], False))
    when("const", lambda wanted: ~_equals(value, wanted))
    when("minimum", lambda least: numeric & (number < least))
    when("maximum", lambda most: numeric & (number > most))
    when("exclusiveMinimum", lambda least: numeric & (number <= least))
    when("exclusiveMaximum", lambda most: numeric & (number >= most))
    when("multipleOf", lambda step: numeric & (F.floor(number / step) != number / step))
    text = F.when(_is(value, "string"), F.try_variant_get(value, "$", "string"))
    when("minLength", lambda least: F.length(text) < least)
    when("maxLength", lambda most: F.length(text) > most)
    when("pattern", lambda pattern: ~F.regexp_like(text, F.lit(pattern)))
    for keyword, wrong in (("anyOf", lambda n, _: n == 0), ("oneOf", lambda n, _: n != 1), ("allOf", lambda n, all_: n != all_)):
        when(keyword, lambda parts, wrong=wrong: wrong(sum((valid(p).cast("int") for p in parts), F.lit(0)), len(parts)))
    when("not", valid)
    if {"items", "minItems", "maxItems", "uniqueItems"} & set(schema):
        found.append(let(F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>")), lambda xs: _items(schema, xs, path)))
    if {"properties", "required", "additionalProperties", "minProperties", "maxProperties"} & set(schema):
        fields = F.when(_is(value, "object"), F.try_variant_get(value, "$", "map<string, variant>"))
        found.append(let(fields, lambda m: _properties(schema, m, path)))
    return F.concat(*found) if found else F.array().cast("array<string>")


def _items(schema: dict, xs: Column, path: str) -> Column:
    """Violations of an array's keywords; none where the array is null."""
    found = [
        _report(F.size(xs) < schema.get("minItems", 0), "minItems", path),
        _report(F.size(F.array_distinct(F.transform(xs, lambda x: F.to_json(x)))) < F.size(xs), "uniqueItems", path)
        if schema.get("uniqueItems") else F.array().cast("array<string>"),
    ]
    if "maxItems" in schema:
        found.append(_report(F.size(xs) > schema["maxItems"], "maxItems", path))
    if "items" in schema:
        found.append(F.array_distinct(F.flatten(F.transform(xs, lambda x: violations(schema["items"], x, f"{path}[]")))))
    return F.when(xs.isNotNull(), F.concat(*found)).otherwise(F.array().cast("array<string>"))


def _properties(schema: dict, fields: Column, path: str) -> Column:
    """Violations of an object's keywords; none where the object is null."""
    keys, properties, more = F.map_keys(fields), schema.get("properties", {}), schema.get("additionalProperties", True)

    def at(name: str) -> str:
        return f"{path}.{name}" if path else name

    found = [_report(~F.array_contains(keys, name), "missing", at(name)) for name in schema.get("required", ())]
    for name, part in properties.items():
        one = violations(part, F.try_element_at(fields, F.lit(name)), at(name))
        found.append(F.when(F.array_contains(keys, name), one).otherwise(F.array().cast("array<string>")))
    others = F.filter(F.array_sort(keys), lambda k: ~k.isin(*properties)) if properties else F.array_sort(keys)
    if more is False:
        found.append(F.transform(others, lambda k: F.concat(F.lit(f"unknown:{at('')}"), k)))
    elif more is not True:
        of_others = F.transform(others, lambda k: violations(more, F.try_element_at(fields, k), at("*")))
        found.append(F.array_distinct(F.flatten(of_others)))
    if "minProperties" in schema:
        found.append(_report(F.size(keys) < schema["minProperties"], "minProperties", path))
    if "maxProperties" in schema:
        found.append(_report(F.size(keys) > schema["maxProperties"], "maxProperties", path))
    empty = F.array().cast("array<string>")
    return F.when(fields.isNotNull(), F.concat(empty, *found)).otherwise(empty)
