"""Session construction, and the shared folder for checkpoints and tables."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# AQE does the run-time work this package relies on: it turns a join into a
# broadcast when the measured side is small, and into a hash join (no sort of the
# document side) when each partition of the metadata side fits the threshold; it
# splits skewed join partitions and coalesces small shuffle partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.session.timeZone": "UTC",
    # models are fitted side by side, each in a pool of its own
    "spark.scheduler.mode": "FAIR",
}


def build_session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine settings; on a cluster ``master`` stays unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process, may
    fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_FOLDERS.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="scriptorium-")
        log.warning("spark.checkpoint.dir is not set: this local session writes to %s", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_RUNS: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the folder of the run that is open."""
    base = _RUNS[-1] if _RUNS else shared_dir(spark)
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for what a job writes on its way, removed when the block ends.

    What the caller keeps must be written elsewhere, or held (see ``held``), before
    the end of the block.
    """
    folder = new_path(spark, "run")
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(report: DataFrame) -> DataFrame:
    """A report of a few rows as a table of its own, independent of files. Only for bounded reports."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def settle(df: DataFrame, label: str = "table", partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back.

    Cuts lineage before iterative fits; the copy outlives a lost executor and,
    being parquet, still prunes columns for each reader. Filters on the
    ``partition_by`` column then read only their own folder.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
