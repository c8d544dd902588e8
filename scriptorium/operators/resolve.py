"""Match metadata rows to corpus files through candidate names in priority order.

A reference can name its file in eleven ways: six spellings of the whole
reference (positions 0-5) and five of its first number (positions 6-10). The
first candidate that exists wins.

Only keys and names take part: each reference is exploded into its spellings (three,
six if it has spaces) and joined with the file listing; numbered files are reduced
to the best file per number and joined on the number, so a popular number is one row
on the file side. The hits alone are reduced to one a row and joined back by key. Rows
without a reference or number enter no join but the last, which spreads by key.

Only names travel through these joins; document text is joined later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.coerce import strip
from scriptorium.schema import ORDER_COLUMNS

# --- fixed values: file-name spellings by position ---------------------------
LITERAL_SUFFIXES = {0: "", 1: ".txt", 5: ".txt.txt"}
NUMBERED_SPELLINGS = {
    6: r"^file-(\p{Nd}+)\.txt$",
    7: r"^file_(\p{Nd}+)\.txt$",
    8: r"^file (\p{Nd}+)\.txt$",
    9: r"^file (\p{Nd}+)\.txt\.txt$",
    10: r"^file(\p{Nd}+)\.txt$",
}
ANY_NUMBERED = r"^file[-_ ]?(\p{Nd}+)\.txt(?:\.txt)?$"


def _candidate(position: int, name: Column) -> Column:
    return F.struct(F.lit(position).alias("position"), name.alias("file_name"))


def literal_candidates(ref: Column) -> Column:
    """Spellings of the whole reference; the spaced ones only if it has a space."""
    same = [_candidate(p, F.concat(ref, F.lit(s))) for p, s in LITERAL_SUFFIXES.items()]
    dashed = F.replace(ref, F.lit(" "), F.lit("-"))
    spaced = [
        _candidate(2, F.concat(dashed, F.lit(".txt"))),
        _candidate(3, dashed),
        _candidate(4, F.concat(F.replace(ref, F.lit(" "), F.lit("_")), F.lit(".txt"))),
    ]
    return F.when(F.contains(ref, F.lit(" ")), F.array(*same, *spaced)).otherwise(F.array(*same))


def first_number(ref: Column) -> Column:
    """First digit run of the reference, or NULL."""
    return F.nullif(F.regexp_extract(ref, r"(\p{Nd}+)", 1), F.lit(""))


def best_numbered_files(listing: DataFrame) -> DataFrame:
    """Per number, the existing file whose spelling comes first."""
    name = F.col("file_name")
    position = F
    for pos, pattern in NUMBERED_SPELLINGS.items():
        position = position.when(F.rlike(name, F.lit(pattern)), F.lit(pos))
    numbered = listing.select(
        F.nullif(F.regexp_extract(name, ANY_NUMBERED, 1), F.lit("")).alias("_number"),
        F.struct(position.alias("position"), name.alias("file_name")).alias("_file"),
    )
    numbered = numbered.where(F.col("_number").isNotNull() & F.col("_file.position").isNotNull())
    return numbered.groupBy("_number").agg(F.min("_file").alias("_by_number"))


def resolve_script_files(
    movies: DataFrame, listing: DataFrame, ref: str = "script_file", key: Sequence[str] = ORDER_COLUMNS
) -> DataFrame:
    """Add ``file_name`` and ``candidate_position`` to every row; NULL if no file exists.

    ``key`` identifies a row.
    """
    keyed = movies.select(*key, F.nullif(strip(F.col(ref)), F.lit("")).alias("_ref")).where("_ref is not null")
    spelled = keyed.select(*key, F.explode(literal_candidates(F.col("_ref"))).alias("_hit"))
    files = listing.select(F.col("file_name").alias("_file"))
    by_name = spelled.join(files, F.col("_hit.file_name") == F.col("_file")).select(*key, "_hit")
    numbered = keyed.select(*key, first_number(F.col("_ref")).alias("_number")).where("_number is not null")
    by_number = numbered.join(best_numbered_files(listing), "_number").select(*key, F.col("_by_number").alias("_hit"))
    best = by_name.unionByName(by_number).groupBy(*key).agg(F.min("_hit").alias("_hit"))
    return movies.join(best, list(key), "left").select(
        *(movies[c] for c in movies.columns), F.col("_hit.file_name").alias("file_name"), F.col("_hit.position").alias("candidate_position")
    )
