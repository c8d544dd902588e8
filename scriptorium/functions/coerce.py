"""Typed values out of raw metadata strings.

The session is ANSI by default, so every conversion is a ``try_cast``: a value
that does not parse becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import WHITESPACE
from scriptorium.schema import DEFAULTS


def strip(col: Column) -> Column:
    """Remove whitespace, Unicode kinds included, from both ends."""
    return F.regexp_replace(col, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def to_double(col: Column) -> Column:
    """Number or NULL. Java's ``7.5d`` / ``7.5f`` spellings are not numbers here."""
    text = strip(col.cast("string"))
    return F.when(~F.rlike(text, F.lit("[dDfF]$")), text.try_cast("double"))


def to_rating(col: Column) -> Column:
    """Rating as a number; NULL if missing, NaN or not numeric."""
    value = to_double(col)
    return F.when(~F.isnan(value), value)


def is_valid_rating(rating: Column) -> Column:
    """0 <= rating <= 10; NULL and NaN are invalid (NaN sorts above 10)."""
    return F.coalesce(rating.between(0.0, 10.0) & ~F.isnan(rating), F.lit(False))


def to_year(col: Column, default: int = DEFAULTS.default_year) -> Column:
    """Whole year, truncated towards zero, or the default."""
    return F.coalesce(to_double(col).try_cast("int"), F.lit(default))


def to_decade(col: Column, default: str = DEFAULTS.default_decade) -> Column:
    return F.coalesce(col, F.lit(default))


def to_length(col: Column, default: float = DEFAULTS.default_length) -> Column:
    """Positive running time in minutes, or the default."""
    value = to_double(col)
    return F.when((value > 0) & ~F.isnan(value), value).otherwise(F.lit(default))


def to_name(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("Unknown"))


def to_script_ref(col: Column) -> Column:
    """Trimmed file reference that always ends in ``.txt``."""
    ref = strip(col)
    return F.when(F.endswith(ref, F.lit(".txt")), ref).otherwise(F.concat(ref, F.lit(".txt")))
