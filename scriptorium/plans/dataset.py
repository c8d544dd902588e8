"""Loading: metadata plus corpus to one keyed table of model-ready documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.coerce import to_decade, to_length, to_name, to_rating, to_script_ref, to_year
from scriptorium.functions.text import clean_text, text_features
from scriptorium.operators.dedup import keep_first, keep_last
from scriptorium.operators.gates import filter_min_length, filter_valid_rating, with_outcome
from scriptorium.operators.resolve import resolve_script_files
from scriptorium.schema import DEFAULTS, Settings


TASKS_PER_CORE = 4  # so that the last tasks of a stage do not wait for one another


def partitioned(df: DataFrame, settings: Settings = DEFAULTS, *keys: str) -> DataFrame:
    """The rows over ``settings.text_partitions`` tasks or four a core, or as they are if it is not set.

    Rows with equal ``keys``, if given, come together: what follows by them needs no shuffle.
    """
    if not settings.text_partitions:
        return df
    tasks = max(settings.text_partitions, TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def cleaned_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace raw text by its sixteen features and its cleaned form. Narrow."""
    return text_features(docs, text).withColumn("clean", clean_text(F.col(text))).drop(text)


def typed_metadata(movies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Coerce the raw strings, with the defaults for what is missing."""
    return movies.select(
        F.concat_ws(":", "source_ordinal", "row_ordinal").alias("doc_key"),
        "script_file",
        "file_name",
        to_name(F.col("movie_name")).alias("movie_name"),
        to_rating(F.col("rating")).alias("rating"),
        to_year(F.col("year"), settings.default_year).alias("year"),
        to_decade(F.col("decade"), settings.default_decade).alias("decade"),
        to_length(F.col("movie_length"), settings.default_length).alias("movie_length"),
    )


def load_dataset(movies: DataFrame, corpus: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per document that passes every gate: metadata, features, cleaned text.

    Metadata is deduplicated, gated and matched to file names first. Documents then
    meet it before any pattern runs, so a file that no row refers to costs its read
    alone. Terms are derived after the join: the cleaned text is a third of their size.
    """
    unique = keep_first(movies).withColumn("rating", to_rating(F.col("rating")))
    rated = filter_valid_rating(unique)
    matched = resolve_script_files(rated, corpus.select("file_name"))
    metadata = typed_metadata(matched.where(F.col("file_name").isNotNull()), settings)
    documents = filter_min_length(corpus.select("file_name", "text"), settings=settings)
    return cleaned_features(partitioned(metadata.join(documents, "file_name"), settings))


def label_dataset(movies: DataFrame, corpus: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every deduplicated row with the outcome of loading it (the quarantine table)."""
    sizes = corpus.select("file_name", F.length("text").alias("n_chars"))
    return with_outcome(keep_first(movies), sizes, settings)


def metadata_by_file(movies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Evaluation lookup: per ``.txt`` name the last row's year, decade, length, title."""
    named = movies.withColumn("file_name", to_script_ref(F.col("script_file"))).where(F.col("file_name").isNotNull())
    last = keep_last(named, ["file_name"])
    typed = typed_metadata(last, settings)
    return typed.select("file_name", "movie_name", "year", "decade", "movie_length")


def lookup_metadata(files: DataFrame, lookup: DataFrame, codes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``year, decade_encoded, movie_length`` per file, defaults where unknown."""
    encoded = lookup.join(codes, "decade", "left").select(
        "file_name", "year", F.coalesce("decade_encoded", F.lit(0)).alias("decade_encoded"), "movie_length"
    )
    return with_scoring_defaults(files.join(encoded, "file_name", "left"), settings)


def with_scoring_defaults(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fill the metadata a scoring input may lack; absent columns are added."""
    defaults = {
        "year": F.lit(settings.default_scoring_year),
        "decade_encoded": F.lit(0),
        "movie_length": F.lit(settings.default_length),
    }
    return df.withColumns(
        {c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()}
    )

