"""Ordered deduplication and duplicate reports.

Relational input has no row order, so "first" and "last" are always by explicit
order columns. The ``row_number() = 1`` filter makes Spark keep one row per key
in every map task before the shuffle (``WindowGroupLimit``), so a key that holds
a third of the table still sends only one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.schema import ORDER_COLUMNS


def _keep_one(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def keep_first(
    df: DataFrame, keys: Sequence[str] = ("script_file",), order: Sequence[str] = ORDER_COLUMNS
) -> DataFrame:
    """First row per key; NULL keys count as one key."""
    return _keep_one(df, keys, [F.col(c).asc() for c in order])


def keep_last(
    df: DataFrame, keys: Sequence[str] = ("script_file",), order: Sequence[str] = ORDER_COLUMNS
) -> DataFrame:
    """Last row per key; NULL keys count as one key."""
    return _keep_one(df, keys, [F.col(c).desc() for c in order])


def keep_first_by_file_and_title(df: DataFrame) -> DataFrame:
    """The audit's stricter rule: first by file, then first by title."""
    return keep_first(keep_first(df, ["script_file"]), ["movie_name"])


def duplicate_counts(df: DataFrame, keys: Sequence[str] = ("script_file",)) -> DataFrame:
    """One row: rows in, distinct keys, and rows that are not the first of their key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_titles(df: DataFrame, name: str = "movie_name") -> DataFrame:
    """Titles that occur more than once, with their counts; NULL is no title."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") > 1)


def duplicate_title_summary(df: DataFrame, name: str = "movie_name") -> DataFrame:
    """One row: repeated names, their rows, and the rows beyond the first of each."""
    titles = duplicate_titles(df, name)
    return titles.agg(
        F.count(F.lit(1)).alias("names"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("extra_rows"),
    )


def expand_duplicates(df: DataFrame, name: str = "movie_name") -> DataFrame:
    """Every row whose title is repeated, with the title's count.

    Counting first and joining back keeps a hot title out of a single window
    partition: the count side has one row per title, and AQE splits the other.
    """
    return df.join(duplicate_titles(df, name), name, "inner")
