"""Decade codes and standard scaling, fitted once and stored as small tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.schema import NUMERIC_FEATURES

MAX_LABELS = 10_000

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
    ]
)


def decade_codes(df: DataFrame, decade: str = "decade") -> DataFrame:
    """``decade, decade_encoded``: position in the sorted distinct labels.

    Distinct first, so the ranking sees one row per label, never per document.
    """
    labels = df.where(F.col(decade).isNotNull()).select(decade).distinct()
    code = F.row_number().over(Window.orderBy(decade)) - 1
    return labels.select(decade, code.alias("decade_encoded"))


def encode_decades(df: DataFrame, codes: DataFrame, decade: str = "decade") -> DataFrame:
    """Add ``decade_encoded``; a label that was not fitted is 0.

    A shuffle by label would put all documents of a decade into one task, so the
    labels are counted and, up to ``MAX_LABELS``, broadcast. More than that are no
    hot keys, and join as AQE sees fit.
    """
    few = codes.limit(MAX_LABELS + 1).count() <= MAX_LABELS
    joined = df.join(F.broadcast(codes) if few else codes, decade, "left")
    return joined.withColumn("decade_encoded", F.coalesce("decade_encoded", F.lit(0)))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature scales by 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def columns(self) -> dict:
        """Scaled columns under their own names, in feature order."""
        return {
            f: (F.col(f).cast("double") - F.lit(m)) / F.lit(s if s > 0 else 1.0)
            for f, m, s in zip(self.features, self.means, self.stds)
        }

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.features)), self.features, self.means, self.stds)
        return spark.createDataFrame(list(rows), SCALER_SCHEMA)

    @staticmethod
    def from_table(df: DataFrame) -> "Scaler":
        rows = df.orderBy("position").collect()
        return Scaler(
            tuple(r["feature"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows)
        )


def scaler_stats(df: DataFrame, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """``feature, mean, std`` in one aggregation of one row, unpivoted."""
    aggs = []
    for f in features:
        value = F.col(f).cast("double")
        aggs += [F.avg(value).alias(f"{f}_mean"), F.stddev_pop(value).alias(f"{f}_std")]
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"), F.col(f"{f}_std").alias("std"))
        for f in features
    ]
    return df.agg(*aggs).select(F.inline(F.array(*pairs)))


def fit_scaler(df: DataFrame, features: Sequence[str] = NUMERIC_FEATURES) -> Scaler:
    """Collects two numbers per feature."""
    stats = {r["feature"]: r for r in scaler_stats(df, features).collect()}
    return Scaler(
        tuple(features),
        tuple(stats[f]["mean"] for f in features),
        tuple(stats[f]["std"] for f in features),
    )
