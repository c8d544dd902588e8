"""The split manifest: which document went to training and which to testing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.schema import DEFAULTS, Settings
from scriptorium.sources.metadata import path_exists

MANIFEST_COLUMNS = ("script_file", "movie_name", "rating", "split")
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("script_file", T.StringType()),
        T.StructField("movie_name", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("split", T.StringType()),
    ]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("total_samples", T.LongType()),
        T.StructField("test_size", T.DoubleType()),
        T.StructField("random_state", T.IntegerType()),
    ]
)


def write_split_manifest(df: DataFrame, path: str, settings: Settings = DEFAULTS) -> None:
    """Documents as parquet partitioned by split, run parameters as JSON."""
    documents = df.select(*MANIFEST_COLUMNS)
    documents.write.mode("overwrite").partitionBy("split").parquet(f"{path}/documents")
    spark = df.sparkSession
    total = spark.read.parquet(f"{path}/documents").count()
    run = spark.createDataFrame([(total, settings.test_size, settings.seed)], RUN_SCHEMA)
    run.coalesce(1).write.mode("overwrite").json(f"{path}/run")


def read_split_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Documents of a manifest; only the partition of ``split`` if one is named."""
    if not path_exists(spark, f"{path}/documents"):
        raise FileNotFoundError(f"no split manifest at {path}; train first")
    documents = spark.read.parquet(f"{path}/documents")
    absent = [c for c in MANIFEST_COLUMNS if c not in documents.columns]
    if absent:
        raise ValueError(f"split manifest at {path} lacks {', '.join(absent)}; train again")
    documents = documents.select(*MANIFEST_COLUMNS)
    return documents.where(F.col("split") == split) if split else documents


def read_run(spark: SparkSession, path: str) -> dict:
    """The one-row run parameters."""
    row = spark.read.schema(RUN_SCHEMA).json(f"{path}/run").first()
    return json.loads(json.dumps(row.asDict()))
