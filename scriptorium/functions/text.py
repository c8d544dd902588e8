"""Text cleaning and structural features as Catalyst expressions.

Definitions follow Unicode rules: whitespace includes U+001C..U+001F, U+0085,
NBSP and the space separators; only ``\\n`` ends a line; word characters are
letters, numbers and underscore. Java's shorthand classes differ from that in
small ways, so the classes are spelled out.

Each pattern is written to scan forward without backing up over long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.schema import TEXT_FEATURES

# --- fixed values: character classes -----------------------------------------
_ASCII_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
_WIDE_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE = _ASCII_SPACE + _WIDE_SPACE
WORD_CHAR = r"\p{L}\p{N}_"
LETTER_I = r"iI\x{130}\x{131}"  # equal to i when case is ignored
LETTER_S = r"sS\x{17f}"  # equal to s when case is ignored

# The same spaces for hot loops: the wide ones hide behind one range test.
SPACE = rf"{_ASCII_SPACE}[\x{{1680}}-\x{{3000}}&&[{_WIDE_SPACE}]]"


def _likely(chars: str) -> str:
    """A class for ``chars`` or anything beyond Latin-1, as one table lookup.

    It rejects nearly every position at once; a lookbehind then tests exactly.
    """
    return "[^" + "".join(rf"\x{c:02x}" for c in range(256) if chr(c) not in chars) + "]"


# --- fixed values: patterns --------------------------------------------------
BRACKETED = r"\[[^\]\n]*+\]"
PARENTHESIZED = r"\([^)\n]*+\)"
SPEAKER_CUE = rf"(?dm)^[A-Z][A-Z{WHITESPACE}]++:"
TIMESTAMP = r"\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?"
# "int" or "ext" in any case, not inside a word: the tail "nt"/"xt" is looked
# for first, as it is rarer than its first letter
_INT_EXT_TAIL = rf"[nNxX][tT](?<=[{LETTER_I}][nN].|[eE][xX].)(?<![{WORD_CHAR}]...)"
INT_EXT = rf"{_likely('iIeE')}{_INT_EXT_TAIL}(?:\.(?=[{WORD_CHAR}])|(?![{WORD_CHAR}]))"
SCENE_HEADING = rf"{_INT_EXT_TAIL}\.?[{WHITESPACE}]"
SCENE_NUMBER = (
    rf"{_likely('sS')}[cC][eE][nN][eE](?<=[{LETTER_S}]....)(?<![{WORD_CHAR}].....)"
    rf"[{WHITESPACE}]*+\p{{Nd}}++(?![{WORD_CHAR}])"
)
# Single characters, not ranges: Java tests a class of single Latin-1 characters
# with one table lookup, and ranges one after another (measured 8x slower).
KEPT = ascii_lowercase + ascii_uppercase + digits + "'.,!?"
# The wide spaces are looked at behind the few characters that the table lets through.
NOT_KEPT = f"[^{KEPT}{_ASCII_SPACE}](?<![{_WIDE_SPACE}])"
NOT_KEPT_RUN = f"[^{KEPT}]+"

# A letters-only run from a line start: dropped when a colon ends it, put back
# (group 1) when not. Consuming the runs that stay keeps the scan linear on
# texts with many unpunctuated lines.
_SPEAKER_RUN = rf"(?idmu)^(?:[A-Z][A-Z{WHITESPACE}]++:|([A-Z][A-Z{WHITESPACE}]++))"


# --- cleaning steps ----------------------------------------------------------


def text_lower(text: Column) -> Column:
    return F.lower(text)


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, BRACKETED, " ")


def strip_parens(text: Column) -> Column:
    return F.regexp_replace(text, PARENTHESIZED, " ")


def strip_speakers(text: Column) -> Column:
    """Remove ``NAME:`` runs; the line break before them is the separator left."""
    return F.regexp_replace(text, _SPEAKER_RUN, "$1")


def strip_timestamps(text: Column) -> Column:
    return F.regexp_replace(text, TIMESTAMP, " ")


def strip_scene_numbers(text: Column) -> Column:
    return F.regexp_replace(text, SCENE_NUMBER, " ")


def strip_int_ext(text: Column) -> Column:
    return F.regexp_replace(text, INT_EXT, " ")


def strip_symbols(text: Column) -> Column:
    return F.regexp_replace(text, NOT_KEPT, " ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def _if_any(text: Column, sign: str, *steps: Callable[[Column], Column]) -> Column:
    """The steps on a text that has ``sign``; any other has nothing for them to match.

    The text is a lambda variable, so the steps before are computed once a row.
    """

    def guarded(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(sign)), reduce(lambda out, step: step(out), steps, t)).otherwise(t)

    return F.transform(F.array(text), guarded)[0]


def clean_text(text: Column) -> Column:
    """All steps in order; the last two run as one replacement."""
    out = text_lower(text)
    out = _if_any(out, "[", strip_brackets)
    out = _if_any(out, "(", strip_parens)
    out = _if_any(out, ":", strip_speakers, strip_timestamps)
    out = _if_any(out, "cene", strip_scene_numbers)
    out = strip_int_ext(out)
    return F.trim(F.regexp_replace(out, NOT_KEPT_RUN, " "))


# --- structural features -----------------------------------------------------


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _speaker_names(text: Column) -> Column:
    cues = F.regexp_extract_all(text, F.lit(SPEAKER_CUE), F.lit(0))
    return F.transform(cues, lambda cue: F.regexp_replace(cue, f"[{WHITESPACE}]*:$", ""))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the sixteen structural features of the raw text column.

    Three narrow projections: intermediate values, counts, ratios. Nothing here
    shuffles; words and sentences are measured on the whitespace-collapsed text
    by pattern counts, so no per-word array except for the distinct-word count.
    """
    raw = F.col(text)
    inner = [c for c in df.columns]
    staged = df.select(*inner, collapse_whitespace(raw).alias("_flat"))
    flat = F.col("_flat")
    counted = staged.select(
        *inner,
        F.length(flat).alias("_flat_chars"),
        F.when(F.length(flat) > 0, _count_char(flat, " ") + 1).otherwise(F.lit(0)).alias("word_count"),
        F.when(F.length(flat) > 0, F.size(F.array_distinct(F.split(flat, " ")))).otherwise(F.lit(0)).alias("_unique"),
        _count_matches(flat, "[^ ]{8,}").alias("_long"),
        _count_matches(flat, "[^.!? ][^.!?]*+").alias("sentence_count"),
        _sentence_marks(flat).alias("_marks"),
        F.length(raw).alias("char_count"),
        (_count_char(raw, "\n") + 1).alias("line_count"),
        _speaker_names(raw).alias("_names"),
        _count_char(raw, "!").alias("_exclaims"),
        _count_char(raw, "?").alias("_questions"),
        (_count_matches(raw, BRACKETED) + _count_matches(raw, PARENTHESIZED)).alias("_actions"),
        _count_matches(raw, SCENE_HEADING).alias("scene_count"),
    )
    words = F.col("word_count")
    sentences = F.col("sentence_count")
    per_words = F.greatest(words, F.lit(1))
    measured = counted.select(
        *inner,
        "char_count", "word_count", "line_count", "sentence_count", "scene_count",
        "_flat_chars", "_unique", "_long", "_exclaims", "_questions", "_actions",
        F.size("_names").alias("_cues"),
        F.size(F.array_distinct("_names")).alias("unique_characters"),
        _count_char(F.col("_marks"), "x").cast("double").alias("_s1"),
        _sum_of_squared_runs(F.col("_marks")).alias("_s2"),
    )
    # population deviation of whole numbers, from exact sums: m*S2 - S1^2
    s1, s2 = F.col("_s1"), F.col("_s2")
    values = {
        "avg_word_length": _ratio(F.col("_flat_chars") - words + 1, words),
        "unique_word_ratio": _ratio(F.col("_unique"), words),
        "long_word_ratio": _ratio(F.col("_long"), words),
        "avg_sentence_length": _ratio(s1, sentences),
        "sentence_length_std": F.when(
            sentences > 0, F.sqrt(F.greatest(sentences * s2 - s1 * s1, F.lit(0.0))) / sentences
        ).otherwise(F.lit(0.0)),
        "dialogue_density": F.col("_cues").cast("double") / F.greatest(F.col("line_count"), F.lit(1)),
        "exclamation_ratio": F.col("_exclaims").cast("double") / per_words * 100,
        "question_ratio": F.col("_questions").cast("double") / per_words * 100,
        "action_density": F.col("_actions").cast("double") / per_words * 100,
        "words_per_scene": words.cast("double") / F.greatest(F.col("scene_count"), F.lit(1)),
    }
    return measured.select(*inner, *(values.get(n, F.col(n)).alias(n) for n in TEXT_FEATURES))


def _sentence_marks(flat: Column) -> Column:
    """Every word as one ``x``, spaces dropped: a sentence is a run of marks."""
    return F.replace(F.regexp_replace(flat, "[^.!? ]++", "x"), F.lit(" "), F.lit(""))


def _sum_of_squared_runs(marks: Column) -> Column:
    """Sum over sentences of the squared word count."""
    runs = F.regexp_extract_all(marks, F.lit("x++"), F.lit(0))
    return F.aggregate(runs, F.lit(0.0), lambda total, run: total + F.length(run).cast("double") * F.length(run))
