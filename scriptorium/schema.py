"""Names, types and default parameters shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: input headers and the column each one is stored under -----
HEADER_TO_COLUMN = {
    "Movie name": "movie_name",
    "Year": "year",
    "IMDb Rating": "rating",
    "IMDb ID": "imdb_id",
    ".txt Files": "script_file",
    "Collected By": "collected_by",
    "Decade": "decade",
    "Movie length": "movie_length",
}
HEADER_TYPOS = {"Decaade": "Decade"}

EXPECTED_COLUMNS = tuple(HEADER_TO_COLUMN.values())
ORDER_COLUMNS = ("source_ordinal", "row_ordinal")

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("source_ordinal", T.IntegerType()),
        T.StructField("row_ordinal", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in EXPECTED_COLUMNS),
    ]
)

# --- fixed values: numeric features, in model order --------------------------
TEXT_FEATURES = (
    "char_count",
    "word_count",
    "line_count",
    "avg_word_length",
    "unique_word_ratio",
    "long_word_ratio",
    "sentence_count",
    "avg_sentence_length",
    "sentence_length_std",
    "dialogue_density",
    "unique_characters",
    "exclamation_ratio",
    "question_ratio",
    "action_density",
    "scene_count",
    "words_per_scene",
)
NUMERIC_FEATURES = TEXT_FEATURES + ("year", "movie_length", "decade_encoded")

# --- fixed values: rating ranges [low, high) ---------------------------------
RATING_RANGES = (("Low", 1, 4), ("Medium", 4, 6), ("Good", 6, 8), ("Excellent", 8, 10))

OUTCOMES = ("loaded", "invalid_rating", "missing", "short", "error")


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults are the published configuration."""

    test_size: float = 0.30
    seed: int = 42
    max_features: int = 8000
    min_df: int = 3
    max_df: float = 0.85
    min_chars: int = 1000
    min_scoring_chars: int = 100
    min_documents: int = 100
    default_year: int = 2000
    default_scoring_year: int = 2020
    default_decade: str = "2000s"
    default_length: float = 120.0
    # Least number of tasks for text work, where a corpus has few or uneven splits (four a
    # core, if those are more); None keeps the scan's own, as a balanced packed corpus can.
    text_partitions: int | None = None


DEFAULTS = Settings()
