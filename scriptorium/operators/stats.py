"""Rating statistics and load summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.coerce import to_rating
from scriptorium.functions.rating import rating_range


def rating_stats_by_source(movies: DataFrame, source: str = "source_ordinal") -> DataFrame:
    """Rows and rating span per source; every numeric rating counts, in range or not."""
    rating = to_rating(F.col("rating"))
    return movies.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(rating).alias("n_ratings"),
        F.min(rating).alias("min_rating"),
        F.max(rating).alias("max_rating"),
    )


def rating_stats(df: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: count, span, mean and population deviation."""
    value = F.col(rating)
    return df.agg(
        F.count(value).alias("n_ratings"),
        F.min(value).alias("min_rating"),
        F.max(value).alias("max_rating"),
        F.avg(value).alias("mean_rating"),
        F.stddev_pop(value).alias("std_rating"),
    )


def load_summary(labelled: DataFrame) -> DataFrame:
    """Rows per outcome plus a ``total`` row, in one pass."""
    counts = labelled.rollup("outcome").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select(F.coalesce("outcome", F.lit("total")).alias("outcome"), "n_rows")


def range_counts(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows per rating range; rows outside every range are left out."""
    ranged = df.select(rating_range(F.col(rating)).alias("rating_range"))
    return ranged.where(F.col("rating_range").isNotNull()).groupBy("rating_range").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and share per split."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # over the two or three counts
    return counts.select(split, "n_rows", (F.col("n_rows") * 100.0 / total).alias("percent"))
