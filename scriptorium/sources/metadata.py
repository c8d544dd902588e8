"""Metadata tables: read, tidy the headers, union by name."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.schema import EXPECTED_COLUMNS, HEADER_TO_COLUMN, HEADER_TYPOS, ORDER_COLUMNS
from scriptorium.sources.workbook import SUFFIXES as WORKBOOK_SUFFIXES
from scriptorium.sources.workbook import read_workbook

log = logging.getLogger(__name__)


def chosen_paths(files: Sequence[str] | str | None, fallback: str) -> list[str]:
    """One path, a list of paths, or the fallback when nothing is given."""
    if isinstance(files, str) and files:
        return [files]
    return list(files) if files else [fallback]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns ``path`` (any Hadoop scheme)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def tidy_header(header: str) -> str:
    """Collapse and trim whitespace, then repair known misspellings."""
    name = " ".join(header.split())
    return HEADER_TYPOS.get(name, name)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename by position, so that equal names after tidying do no harm."""
    return df.toDF(*[tidy_header(c) for c in df.columns])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns."""
    names = df.columns
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return positional.select(*(F.col(f"_{i}").alias(name) for name, i in first.items()))


def ensure_columns(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Add the expected columns that are absent, as NULL strings."""
    absent = absent_columns(df, expected)
    if absent:
        log.warning("columns not found, added as empty: %s", ", ".join(absent))
    return df.withColumns({c: F.lit(None).cast("string") for c in absent})


def absent_columns(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> list[str]:
    return [c for c in expected if c not in df.columns]


def to_engine_columns(df: DataFrame) -> DataFrame:
    """Tidy headers, drop repeats, and give known columns their engine names."""
    df = drop_duplicate_columns(normalize_headers(df))
    return df.toDF(*[HEADER_TO_COLUMN.get(c, c) for c in df.columns])


CSV_OPTIONS = {
    "quote": '"', "escape": '"', "multiLine": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# Within a file: places a file's rows can have, as a power of two.
FILE_ROWS_BITS = 40


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder as strings, with its header's names by position.

    Cells may be quoted, hold doubled quotes and line breaks. The header is read as
    data, since Spark would rename repeated names; each file's own header line is
    then passed over. A file is read as a whole: metadata is small beside a corpus.
    """
    reader = spark.read.options(**CSV_OPTIONS)
    header = reader.option("header", False).csv(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = [name if name is not None else "" for name in header]
    positions = ", ".join(f"_c{i} string" for i in range(len(names)))
    rows = reader.schema(positions).option("header", True).csv(path)
    return rows.select(*rows.columns, row_place(rows, F.monotonically_increasing_id())).toDF(*names, PLACE)


PLACE = "__row_place"


def row_place(df: DataFrame, position: Column) -> Column:
    """Order of a row: its file's rank by path, then its position in the file.

    Spark scans larger files first, so scan order is no order. A file's rows are
    read by one task in order, or, for Parquet, know their index.
    """
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    rank = F.array_position(F.lit(files), F.col("_metadata.file_path")) - 1
    inside = position.bitwiseAND(F.lit((1 << 33) - 1))
    return (F.shiftleft(rank.cast("long"), FILE_ROWS_BITS) + inside).alias(PLACE)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One metadata source; the expected columns are strings, whatever its types.

    A path that ends with ``.parquet`` is a table, with ``.xlsx`` or ``.xlsm`` a
    workbook, and any other CSV. Row order decides which duplicate is kept. A source that has a ``row_ordinal``
    column is ordered by it; any other by file name and place in the file.
    """
    if path.lower().endswith(WORKBOOK_SUFFIXES):
        raw = read_workbook(spark, path, place=PLACE)
    elif path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        raw = rows.select(*(F.col(f"`{c}`") for c in rows.columns), row_place(rows, F.col("_metadata.row_index")))
    else:
        raw = read_csv(spark, path)
    df = to_engine_columns(raw)
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in EXPECTED_COLUMNS if c in df.columns})
    order = F.col("row_ordinal").cast("long") if "row_ordinal" in df.columns else F.col(PLACE)
    return df.withColumn("row_ordinal", order).drop(PLACE)


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing in one source is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def read_metadata(
    spark: SparkSession, files: Sequence[str] | str | None, fallback: str = "metadata.csv"
) -> DataFrame:
    """All metadata sources as one table, in source order.

    Missing and unreadable sources are skipped with a log line; it is an error
    when none is left.
    """
    sources = []
    for ordinal, path in enumerate(chosen_paths(files, fallback)):
        if not path_exists(spark, path):
            log.warning("metadata source not found: %s", path)
            continue
        try:
            source = read_source(spark, path)
        except (PySparkException, Py4JJavaError, ValueError) as err:  # no footer, no header, no schema
            log.error("metadata source not readable: %s (%s)", path, err)
            continue
        sources.append(
            source.withColumns({"source_ordinal": F.lit(ordinal), "source_path": F.lit(path)})
        )
    if not sources:
        raise FileNotFoundError("no metadata source could be read")
    df = ensure_columns(union_sources(sources))
    known = [*ORDER_COLUMNS, *EXPECTED_COLUMNS]
    return df.select(*known, *[c for c in df.columns if c not in known])
