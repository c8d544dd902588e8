"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean expression over a text and its words, true for a document to
reject; the words are cut once for all rules. A sample tells each rule's cost (time over the sample, less that of reading it) and
selectivity (share it rejects); the rules then run in descending order of
rejections per second as the branches of one CASE, so that a dear rule is
evaluated only for documents that no cheaper one has rejected. The order never
changes which documents are kept, as a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import let

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 400
SAMPLE_FRACTION = 0.1


def _filled(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Windows are compared by a 64-bit hash over their words.
    """

    def covered(hashes: Column) -> Column:
        numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            alike = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, k: alike(x, k - 1) | alike(x, k + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def lengths(p: Column) -> Column:
            own = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - x).cast("bigint"))
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(let(numbered, twins), lengths)
        )

    starts = F.sequence(F.lit(1), F.size(words) - F.lit(WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def measures(t: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        _count(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        _dup_lines(t).alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text, never null, and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def base_rules() -> list[Rule]:
    """The two fixed rules: too few words, or over 30 % of words in repeated windows."""
    return [
        Rule("few_words", lambda t, w: F.size(w) < 20),
        Rule("repetitive", lambda t, w: _repeat_words(w) * 100 > F.size(w) * 30),
    ]


def method_rules() -> list[Rule]:
    """Rules beyond the fixed ones. Each needs a large share of a document to be junk."""
    return [
        Rule("symbols", lambda t, w: _count(t, SYMBOLS) * 10 > F.size(w)),
        Rule("exclaiming", lambda t, w: _count(t, "!") * 10 > F.size(w) * 3),
        Rule("shouting", lambda t, w: _count(t, r"\p{Lu}") * 10 > _count(t, r"\p{L}") * 6),
        Rule("dup_lines", lambda t, w: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x))),
        Rule("word_length", lambda t, w: F.length(F.array_join(w, "")) > F.size(w) * 40),
        Rule("no_letters", lambda t, w: _count(t, r"\p{L}") * 5 < F.length(t)),
    ]


def _timed(df: DataFrame, column: Column, rows: int) -> tuple[float, list]:
    started = time.perf_counter()
    got = df.select(column.alias("x")).take(rows)
    return time.perf_counter() - started, got


def ordered(
    documents: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, fraction: float = SAMPLE_FRACTION, seed: int = 7
) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``rows`` documents.

    The sample takes ``fraction`` of the first splits until it has its rows, and
    only Booleans come back. It steers the order of evaluation, never a verdict. A
    rule that rejects nothing in the sample goes last, cheapest first.
    """
    sample = documents.select("text").sample(withReplacement=False, fraction=fraction, seed=seed)
    idle = let(_words(_filled("text")), lambda w: F.size(w) < 0)
    _timed(sample, idle, rows)  # starts readers and compiled code before anything is timed
    reading, _ = _timed(sample, idle, rows)
    scored = []
    for rule in rules:
        took, got = _timed(sample, rejected_by([rule]).isNotNull(), rows)
        cost = max(took - reading, 1e-3) / max(len(got), 1)
        rate = sum(r.x for r in got) / max(len(got), 1)
        scored.append((-rate / cost, cost, rule))
    return [rule for *_, rule in sorted(scored, key=lambda x: x[:2])]


def _first_rejecting(rules: list[Rule], t: Column, words: Column) -> Column:
    first, *rest = rules
    chain = F.when(first.rejects(t, words), F.lit(first.name))
    for rule in rest:
        chain = chain.when(rule.rejects(t, words), F.lit(rule.name))
    return chain


def rejected_by(rules: list[Rule], text: str = "text") -> Column:
    """Name of the first rule, in the given order, that rejects; null for a document to keep."""
    t = _filled(text)
    return let(_words(t), lambda w: _first_rejecting(rules, t, w))


def keep_good(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents no rule rejects, every column kept; a null text has no words and is rejected.

    Costly rules run only for what cheaper ones let through.
    """
    chosen = ordered(documents, rules or base_rules() + method_rules())
    return documents.where(rejected_by(chosen).isNull())


def quality_report(documents: DataFrame) -> DataFrame:
    """Measures and verdict of every document, one row per input row; null texts count as empty."""
    cascade = ordered(documents, method_rules())
    t = _filled("text")

    def judged(words: Column) -> Column:
        def verdict(m: Column) -> Column:
            failed = (m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30)
            kept = F.when(failed, F.lit(False)).otherwise(_first_rejecting(cascade, t, words).isNull())
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return F.struct(*(m[n].alias(n) for n in names), failed.alias("base_failed"), kept.alias("kept"))

        return let(measures(t, words), verdict)

    return documents.select("doc_id", let(_words(t), judged).alias("m")).select("doc_id", "m.*")
