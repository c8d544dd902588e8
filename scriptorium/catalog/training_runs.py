"""Written inputs and trained models that several registered queries share.

Each is made once per session and table folder, from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog.views import view
from scriptorium.operators.split import train_test_split
from scriptorium.plans.dataset import load_dataset, partitioned
from scriptorium.plans.model_store import load_model, save_model
from scriptorium.plans.models import MODEL_ORDER, REFERENCE_CONFIG, RIDGE
from scriptorium.plans.scoring import ScoringModel
from scriptorium.plans.training import TrainingData, TrainingResult, compare_models, prepare_training, split_manifest, train_models
from scriptorium.schema import DEFAULTS
from scriptorium.session import new_path
from scriptorium.catalog.text_files import write_corpus
from scriptorium.sources.manifest import write_split_manifest

CONFIG = REFERENCE_CONFIG
# The given tables lie in one or two splits: text work is dealt over this many tasks.
SETTINGS = replace(DEFAULTS, text_partitions=16)

_MADE: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "movies")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "corpus").select("file_name", "text")


def training(spark: SparkSession, sf_dir: str) -> TrainingData:
    def make():
        return prepare_training(load_dataset(movies(spark, sf_dir), corpus(spark, sf_dir), SETTINGS), SETTINGS)

    return _once(spark, sf_dir, "training", make)


def fitted(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = MODEL_ORDER) -> dict:
    """The named models at full size, each fitted once; those not yet fitted are fitted side by side."""
    data, app = training(spark, sf_dir), spark.sparkContext.applicationId
    new = [n for n in names if (app, sf_dir, n) not in _MADE]
    if new:
        _MADE.update({(app, sf_dir, n): model for n, model in train_models(data, CONFIG, names=new).items()})
    return {n: _MADE[app, sf_dir, n] for n in names}


def compared(spark: SparkSession, sf_dir: str, *names: str) -> TrainingResult:
    """The named models on the test side."""
    return _once(spark, sf_dir, "compared " + ", ".join(names), lambda: compare_models(training(spark, sf_dir), fitted(spark, sf_dir, names)))


def training_result(spark: SparkSession, sf_dir: str) -> TrainingResult:
    """All four models."""
    return compared(spark, sf_dir, *MODEL_ORDER)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of all loaded documents. It needs their metadata and lengths alone, so nothing is trained for it."""
    loaded = load_dataset(movies(spark, sf_dir), corpus(spark, sf_dir), SETTINGS).select("file_name", "movie_name", "rating")
    return split_manifest(train_test_split(loaded, "file_name", SETTINGS))


def written_manifest(spark: SparkSession, sf_dir: str) -> str:
    def make():
        path = new_path(spark, "manifest")
        write_split_manifest(manifest(spark, sf_dir), path)
        return path

    return _once(spark, sf_dir, "manifest", make)


def written_model(spark: SparkSession, sf_dir: str) -> str:
    """A saved model. Ridge, as any fitted model serves for storing and scoring, and it is fitted in seconds."""

    def make():
        result, path = compared(spark, sf_dir, RIDGE), new_path(spark, "model")
        model = ScoringModel(RIDGE, result.models[RIDGE], training(spark, sf_dir).featurizer, result.best_metrics)
        save_model(model, spark, path)
        return path

    return _once(spark, sf_dir, "model", make)


def scorer(spark: SparkSession, sf_dir: str) -> ScoringModel:
    return _once(spark, sf_dir, "scorer", lambda: load_model(spark, written_model(spark, sf_dir)))


def written_corpus(spark: SparkSession, sf_dir: str) -> str:
    """The corpus view as a folder of single text files."""

    def make():
        path = new_path(spark, "corpus")
        files = partitioned(corpus(spark, sf_dir), SETTINGS).select("file_name", F.encode("text", "utf-8").alias("content"))
        write_corpus(files, path)
        return path

    return _once(spark, sf_dir, "files", make)
