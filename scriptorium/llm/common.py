"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import settle, shared_dir

__all__ = ["let", "read_table", "settle", "checkpointed", "text_bytes", "pieces", "slices"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that Spark's own reader resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    The optimiser inlines an aliased column into a lambda, where it would be
    computed for every element; a lambda variable is computed once a row.
    """
    return F.transform(F.array(value), body)[0]


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that ``spark.checkpoint.dir`` names."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of fewer rows: what a task makes of them is held for one part, not for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the index of the first: bounds working memory."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]
