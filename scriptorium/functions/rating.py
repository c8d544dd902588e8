"""Scales and messages derived from a rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schema import RATING_RANGES

# --- fixed values: lower bound -> label --------------------------------------
CATEGORIES = (
    (8.0, "Excellent"),
    (7.0, "Good"),
    (6.0, "Above Average"),
    (5.0, "Average"),
    (4.0, "Below Average"),
)
LOWEST_CATEGORY = "Poor"

# --- fixed values: lower bound, tier, stars, interpretation ------------------
TIERS = (
    (8.0, "Excellent", 5, "This script shows strong potential for critical acclaim."),
    (6.5, "Good", 4, "This script has good commercial potential."),
    (5.0, "Average", 3, "This script may need some improvements."),
    (3.5, "Below Average", 2, "This script likely needs significant revision."),
)
LOWEST_TIER = ("Poor", 1, "This script likely needs significant revision.")


def _ladder(rating: Column, steps, lowest) -> Column:
    """First step whose lower bound the rating reaches, else ``lowest``."""
    out = F
    for bound, value in steps:
        out = out.when(rating >= bound, F.lit(value))
    return out.otherwise(F.lit(lowest))


def rating_range(rating: Column) -> Column:
    """Half-open range name; NULL below 1 and from 10 up."""
    out = F
    for name, low, high in RATING_RANGES:
        out = out.when((rating >= low) & (rating < high), F.lit(name))
    return out


def rating_category(rating: Column) -> Column:
    return F.when(rating.isNotNull(), _ladder(rating, CATEGORIES, LOWEST_CATEGORY))


def quality_tier(rating: Column) -> Column:
    return _ladder(rating, [(t[0], t[1]) for t in TIERS], LOWEST_TIER[0])


def quality_stars(rating: Column) -> Column:
    return F.repeat(F.lit("*"), _ladder(rating, [(t[0], t[2]) for t in TIERS], LOWEST_TIER[1]))


def quality_note(rating: Column) -> Column:
    return _ladder(rating, [(t[0], t[3]) for t in TIERS], LOWEST_TIER[2])


def clip_rating(prediction: Column) -> Column:
    """Limit a prediction to the rating scale."""
    return F.least(F.greatest(prediction, F.lit(1.0)), F.lit(10.0))


def message(rating: Column, file_name: Column | None = None) -> Column:
    """Human-readable result line, naming the file when there is one."""
    shown = rating.cast("string")
    category = rating_category(rating)
    if file_name is None:
        return F.concat(F.lit("Predicted rating: "), shown, F.lit("/10 ("), category, F.lit(")"))
    return F.concat(
        F.lit("Predicted rating for '"), file_name, F.lit("': "), shown, F.lit("/10 ("), category, F.lit(")")
    )
