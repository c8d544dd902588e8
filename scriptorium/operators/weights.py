"""Inverse-frequency sample weights by rating range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.rating import rating_range
from scriptorium.operators.stats import range_counts


def range_weights(df: DataFrame, rating: str = "rating") -> DataFrame:
    """``rating_range, n_rows, weight``: largest range count over own count.

    At most four rows, one per range.
    """
    counts = range_counts(df, rating)
    largest = F.max("n_rows").over(Window.partitionBy())
    return counts.withColumn("weight", largest.cast("double") / F.col("n_rows"))


def sample_weights(df: DataFrame, rating: str = "rating", fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``weight``; 1.0 outside every range. Weights are fitted on ``fit_on``."""
    weights = range_weights(df if fit_on is None else fit_on, rating).select("rating_range", "weight")
    ranged = df.withColumn("rating_range", rating_range(F.col(rating)))
    joined = ranged.join(F.broadcast(weights), "rating_range", "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("rating_range")
