"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them a lexer reads assignments of
source and configuration syntax - ``name = value``, ``name: value``, ``"name" =>
value``, ``NAME=value``, ``name := value``, a URL's query - into pairs of a name
and an expression. An expression is a sum of terms: quoted literals (escapes
and adjacent or added pieces included), bare values, and names. Constants propagate:
a name on the right stands for the literal last bound to it, so ``a = "..."`` and
then ``password = a`` blames the literal at ``a``. Each literal that reaches a name
is scored by how sensitive the name is and how much the value looks like a secret,
and a literal over the threshold is a span of kind ``lexed``.

All work is inside one document and one pass over it; documents are never moved.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the shortest length of each.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "lexed")

# What a name's parts say about its value; the largest part counts.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.9, "bearer": 0.9, "pass": 0.8, "auth": 0.7, "authorization": 0.8, "signature": 0.6,
    "private": 0.5, "access": 0.4, "key": 0.5, "salt": 0.5, "session": 0.4, "cookie": 0.4, "dsn": 0.4,
}
PAIR_SCORES = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("auth", "key"): 0.9}
HARMLESS_PARTS = {"count", "len", "length", "limit", "max", "min", "name", "type", "id", "url", "path", "file", "size", "index", "public"}
# Words count as whole parts of a literal only; a template needs its closing character.
PLACEHOLDER_WORD = re.compile(
    r"(?ai)(?<![a-z0-9])(?:(?:example|sample|dummy|placeholder|changeme|redacted)(?![a-z0-9])|x{4,}(?![a-z0-9]))"
)
PLACEHOLDER = re.compile(
    r"(?ai)^your[_-]|^x{4,}$|^\*{3,}$|^(?:none|null|true|false|todo)$|^\$[a-z_]\w*$|^\$\{[a-z_]\w*\}$|^\$\([^()]*\)$|^%\w+%$|^%\(\w+\)s$"
    r"|^<[^<>]*>$|^\{\{.*\}\}$|^\{[a-z_]\w*\}$"
)
THRESHOLD = 1.3
SHORTEST = 8

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
# A bare value ends before an operator, but for the two = that may pad Base64.
# The statement's name and operator. A name starts where no name character stands
# before it, so a long word is tried once; all repeats are possessive.
_STATEMENT = re.compile(
    rf"""(?a)(?<![A-Za-z0-9_.\-])(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)\]?[\x20\t]*+(?::=|=>|==?=?|:(?!:|//))[\x20\t]*+"""
)
_TERM = re.compile(
    r'''(?a)(?P<raw>"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\')|(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)|(?P<bare>(?:[A-Za-z0-9_.+/~@%$&*^!-]|:(?=//))++={0,2})'''
)
_PLUS = re.compile(r"[\x20\t]*+(?:\+|\.(?=[\x20\t])|\\\n)?[\x20\t]*+")
_IS_NAME = re.compile(rf"(?a)\A\$?\{{?({_NAME})\}}?\Z")


class Literal(NamedTuple):
    start: int
    end: int
    value: str
    quoted: bool


class Value:
    """What a name stands for: literals and other values, in order; shared and never copied."""

    __slots__ = ("parts", "size", "counts", "marked", "hollow")

    def __init__(self, parts: list[Literal | Value]):
        self.parts = parts
        # a placeholder's word in any of the literals; each literal is searched once, where it is gathered
        self.hollow = any(x.hollow if isinstance(x, Value) else bool(PLACEHOLDER_WORD.search(x.value)) for x in parts)
        self.size = sum(x.size if isinstance(x, Value) else len(x.value) for x in parts)
        self.counts: Counter | None = None
        self.marked = False

    def measure(self) -> Counter:
        """Characters of the whole value; each value is counted once."""
        stack = [self]
        while stack:
            top = stack[-1]
            waiting = [x for x in top.parts if isinstance(x, Value) and x.counts is None]
            if waiting and top.counts is None:
                stack += waiting
                continue
            stack.pop()
            if top.counts is None:
                counts = Counter()
                for x in top.parts:
                    counts.update(x.counts if isinstance(x, Value) else x.value)
                top.counts = counts
        return self.counts

    def mark(self, spans: set[tuple[int, int]]) -> None:
        """Add the literals' places; what has been marked before is passed over."""
        stack = [self]
        while stack:
            top = stack.pop()
            if not isinstance(top, Value):
                if top.end > top.start:
                    spans.add((top.start, top.end))
            elif not top.marked:
                top.marked = True
                stack += top.parts


@lru_cache(maxsize=4096)
def name_score(name: str) -> float:
    """0 for a harmless name, up to 1 for one that says it holds a secret."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    low = [p.lower() for p in parts]
    score = max((NAME_SCORES.get(p, 0.0) for p in low), default=0.0)
    score = max([score, *(PAIR_SCORES.get(p, 0.0) for p in zip(low, low[1:], strict=False))])
    if low and low[-1] in HARMLESS_PARTS:
        score *= 0.4
    return score


def value_score(value: str) -> float:
    """0 to 1 by length, mixture of characters and entropy; 0 for a placeholder."""
    if len(value) < SHORTEST or PLACEHOLDER_WORD.search(value) or PLACEHOLDER.search(value):
        return 0.0
    return _mixture_score(len(value), Counter(value))


def _mixture_score(n: int, counts: Counter) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    letters = "".join(counts)
    kinds = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]"))
    spaces = sum(counts[c] for c in " \t\n") / n
    score = min(n, 32) / 32 * 0.3 + min(entropy, 4.5) / 4.5 * 0.5 + (kinds - 2) * 0.15
    return max(0.0, min(1.0, score - 2 * spaces))


def _worth(value: Value) -> float:
    """Score of a value: one literal by all rules, a joined one by its literals' words and its mixture, at any length."""
    if len(value.parts) == 1 and not isinstance(value.parts[0], Value):
        return value_score(value.parts[0].value)
    return 0.0 if value.size < SHORTEST or value.hollow else _mixture_score(value.size, value.measure())


def assignments(text: str) -> Iterator[tuple[str, list[Literal]]]:
    """(name, terms) of each statement, left to right; a bare term may be another name."""
    at = 0
    while found := _STATEMENT.search(text, at):
        pos, terms = found.end(), []
        added = True
        while term := _TERM.match(text, pos):
            quoted = term["raw"] or term["string"]
            if not quoted and not added:
                break  # pieces that stand side by side are one literal only if both are quoted
            edge = (3 if term["raw"] else 1) if quoted else 0
            value = (quoted or term["bare"])[edge : -edge or None]
            terms.append(Literal(term.start() + edge, term.end() - edge, value, bool(quoted)))
            more = _PLUS.match(text, term.end())
            added = "+" in more[0]
            if not quoted and not added:
                break
            pos = more.end()
        yield found["name"], terms
        # a value may itself hold a statement (a query string): go on behind the operator
        at = found.end()


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, by start; positions are code points."""
    if ":" not in text and "=" not in text:
        return []
    bound: dict[str, Value] = {}
    spans: set[tuple[int, int]] = set()
    for name, terms in assignments(text):
        meant: list[Literal | Value] = []
        for term in terms:
            alias = None if term.quoted else _IS_NAME.match(term.value)
            if alias and alias[1] not in bound and "." in term.value and not re.search("[0-9]", term.value):
                continue  # an attribute of something that the text does not define
            meant.append(bound.get(alias[1], term) if alias else term)
        meant = list(dict.fromkeys(x for x in meant if not isinstance(x, Value) or x.size))
        if not meant:
            continue
        value = meant[0] if len(meant) == 1 and isinstance(meant[0], Value) else Value(meant)
        bound[name] = value
        sensitive = name_score(name)
        if sensitive:
            worth = _worth(value)
            if worth and sensitive + worth >= THRESHOLD:
                value.mark(spans)
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


# Whole runs only: what stands before or behind is no hex digit.
_LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}+")


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, digest of the base spans, and all spans."""
    base = base_spans(text)
    counts = Counter(kind for _, kind, _ in base)
    every = sorted(base + [(a, 3, b) for a, b in lexed_spans(text)])
    return counts[0], counts[1], counts[2], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)


def find_secrets(documents: DataFrame) -> DataFrame:
    """One row per document row: counts of base spans, their digest, and all spans.

    A null text is empty; an empty text has no spans and the digest of the empty
    string. Other columns of the input are not read.
    """
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def run(batches):
        for batch in batches:
            rows = [scan(x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(n for n, _ in fields)])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )
