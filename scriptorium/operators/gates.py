"""Quality gates. Rows are labelled, not lost: every gate can be a quarantine table."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.coerce import is_valid_rating, strip, to_rating, to_script_ref
from scriptorium.operators.dedup import keep_first_by_file_and_title
from scriptorium.operators.resolve import resolve_script_files
from scriptorium.schema import DEFAULTS, ORDER_COLUMNS, Settings

log = logging.getLogger(__name__)


def filter_valid_rating(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.where(is_valid_rating(F.col(rating)))


def filter_min_length(df: DataFrame, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """Documents of at least the minimum number of characters."""
    return df.where(F.length(text) >= settings.min_chars)


def _outcome(rating: Column, found: Column, chars: Column, settings: Settings) -> Column:
    return (
        F.when(~is_valid_rating(rating), F.lit("invalid_rating"))
        .when(~found, F.lit("missing"))
        .when(chars.isNull(), F.lit("error"))
        .when(chars < settings.min_chars, F.lit("short"))
        .otherwise(F.lit("loaded"))
    )


def with_outcome(movies: DataFrame, listing: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Label each row with the first gate it fails, or ``loaded``.

    ``listing`` is ``file_name, n_chars``, measured by the corpus scan; NULL
    characters mean that the file exists but could not be read. Only names and
    numbers are joined here.
    """
    rated = movies.withColumn("rating", to_rating(F.col("rating")))
    resolved = resolve_script_files(rated, listing)
    measured = resolved.join(listing.select("file_name", "n_chars"), "file_name", "left")
    outcome = _outcome(F.col("rating"), F.col("file_name").isNotNull(), F.col("n_chars"), settings)
    return measured.withColumn("outcome", outcome)


def audit_skipped(
    movies: DataFrame,
    listing: DataFrame,
    settings: Settings = DEFAULTS,
    by_title: bool = True,
) -> DataFrame:
    """Independent audit: rows a load would skip, with the reason and a detail.

    Differs from the loader on purpose: it also removes repeated titles, knows
    only the plain ``.txt`` name, and measures bytes. ``listing`` is
    ``file_name, n_bytes``.
    """
    rows = keep_first_by_file_and_title(movies) if by_title else movies
    ref = F.coalesce(to_script_ref(F.col("script_file")), F.lit(".txt"))
    rows = rows.withColumns({"file_name": ref, "_rating": to_rating(F.col("rating"))})
    rows = rows.join(listing.select("file_name", "n_bytes"), "file_name", "left")
    reason = (
        F.when(~is_valid_rating(F.col("_rating")), F.lit("invalid_rating"))
        .when(F.col("n_bytes").isNull(), F.lit("missing"))
        .when(F.col("n_bytes") < settings.min_chars, F.lit("too_short"))
    )
    detail = (
        F.when(F.col("reason") == "invalid_rating", F.concat(F.lit("rating="), F.coalesce(F.col("rating"), F.lit("none"))))
        .when(F.col("reason") == "missing", F.col("file_name"))
        .otherwise(F.concat(F.col("file_name"), F.lit(" ("), F.col("n_bytes").cast("string"), F.lit(" bytes)")))
    )
    skipped = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return skipped.select(*ORDER_COLUMNS, "movie_name", "reason", detail.alias("detail"))


def missing_files(movies: DataFrame, listing: DataFrame) -> DataFrame:
    """Every referenced file that is absent from the corpus."""
    refs = movies.select(*ORDER_COLUMNS, "movie_name", to_script_ref(F.col("script_file")).alias("file_name"))
    return refs.where(F.col("file_name").isNotNull()).join(listing, "file_name", "left_anti")


def existing_files(refs: DataFrame, listing: DataFrame, ref: str = "file_name") -> DataFrame:
    """Rows whose file exists in the corpus."""
    names = listing.select(F.col("file_name").alias(ref))
    return refs.join(names, ref, "left_semi")


def scoring_error(text: Column, file_name: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """Why an input cannot be scored, or NULL."""
    checks = F.when(F.coalesce(F.length(strip(text)), F.lit(0)) < settings.min_scoring_chars, F.lit("text is too short"))
    if file_name is None:
        return checks
    named = F.when(file_name.isNotNull() & ~F.endswith(file_name, F.lit(".txt")), F.lit("only .txt files are supported"))
    return F.coalesce(named, checks)


def require_documents(df: DataFrame, settings: Settings = DEFAULTS, allow_small: bool = False) -> bool:
    """Stop, or only warn with ``allow_small``, if there are too few documents."""
    enough = df.limit(settings.min_documents).count() >= settings.min_documents
    if not enough:
        text = f"fewer than {settings.min_documents} documents loaded; results may be unreliable"
        if not allow_small:
            raise ValueError(text)
        log.warning(text)
    return enough
