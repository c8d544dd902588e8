"""Training: split, fit features on the training side, fit and compare models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.rating import clip_rating
from scriptorium.operators.evaluate import best_model, regression_metrics
from scriptorium.operators.scale import Scaler, decade_codes, encode_decades, fit_scaler
from scriptorium.operators.split import exact_train_test_split, train_test_split
from scriptorium.operators.tfidf import TfidfModel, fit_tfidf, with_terms
from scriptorium.operators.weights import sample_weights
from scriptorium.plans.models import MODEL_ORDER, REFERENCE_CONFIG, TREE_MODELS, ModelConfig, estimator, label_stats
from scriptorium.schema import DEFAULTS, NUMERIC_FEATURES, Settings
from scriptorium.session import settle


# Every task of a fit sends sums as wide as the model (trees: nodes x features), however
# few its rows are; fewer rows than this a task would only add to what is merged, and so
# would more tasks than keep the cores busy: a fit runs hundreds of jobs over them.
TRAIN_ROWS_PER_TASK = 2000
TRAIN_TASKS_PER_CORE = 3


def training_tasks(rows: int, cores: int) -> int:
    """Tasks of a fit over so many rows."""
    return max(1, min(-(-rows // TRAIN_ROWS_PER_TASK), TRAIN_TASKS_PER_CORE * cores))


@dataclass(frozen=True)
class Featurizer:
    """Everything fitted on the training documents; all parts are small."""

    tfidf: TfidfModel
    scaler: Scaler
    decades: DataFrame

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the model vector: term weights, then the scaled numeric features."""
        inner = df.columns
        scaled = {f"_scaled_{f}": c for f, c in self.scaler.columns().items()}
        weighted = self.tfidf.transform(with_terms(df)).withColumns(scaled)
        assembler = VectorAssembler(inputCols=["tfidf", *scaled], outputCol=output)
        return assembler.transform(weighted).select(*inner, output)


def fit_featurizer(train: DataFrame, decades: DataFrame, key: str, settings: Settings = DEFAULTS) -> Featurizer:
    """``train`` has the cleaned text and the 19 numeric columns."""
    terms = with_terms(train.select(key, "clean"))
    return Featurizer(fit_tfidf(terms, key, settings), fit_scaler(train, NUMERIC_FEATURES), decades)


def split_manifest(documents: DataFrame) -> DataFrame:
    """Which document is on which side. Of a load that is not written yet, no text is cleaned for it."""
    return documents.select(F.col("file_name").alias("script_file"), "movie_name", "rating", "split")


@dataclass
class TrainingData:
    """Feature tables of both sides, written once for all models."""

    train: DataFrame
    test: DataFrame
    manifest: DataFrame
    featurizer: Featurizer


def prepare_training(
    dataset: DataFrame, settings: Settings = DEFAULTS, key: str = "file_name", exact: bool = False
) -> TrainingData:
    """Split the loaded documents and build both feature tables.

    The document table and the feature table are written to the shared folder:
    the first is read by every fit below, the second by every model. Both are
    partitioned by split, so a fit reads the training side only.
    """
    split = exact_train_test_split if exact else train_test_split
    if exact:  # the exact split counts twice before it writes: not over the whole load
        dataset = settle(dataset, "loaded")
    documents = settle(split(dataset, key, settings), "documents", "split")
    decades = settle(decade_codes(documents), "decades")
    encoded = encode_decades(documents, decades)
    train = encoded.where(F.col("split") == "train")
    featurizer = fit_featurizer(train, decades, "doc_key", settings)
    weighted = sample_weights(encoded, fit_on=train)
    columns = ["doc_key", "file_name", "movie_name", "split", F.col("rating").alias("label"), "weight", "features"]
    features = settle(featurizer.transform(weighted).select(*columns), "features", "split")
    manifest = split_manifest(documents)
    fitted = features.where(F.col("split") == "train")
    return TrainingData(fitted.coalesce(training_tasks(fitted.count(), fitted.sparkSession.sparkContext.defaultParallelism)), features.where(F.col("split") == "test"), manifest, featurizer)


@dataclass
class TrainingResult:
    models: dict[str, Model]
    predictions: DataFrame
    metrics: DataFrame
    best: str
    best_metrics: dict = field(default_factory=dict)


def predictions_of(model: Model, name: str, test: DataFrame) -> DataFrame:
    """``model, script_file, movie_name, actual, predicted`` with clipped predictions."""
    return model.transform(test).select(
        F.lit(name).alias("model"),
        "doc_key",
        F.col("file_name").alias("script_file"),
        "movie_name",
        F.col("label").alias("actual"),
        clip_rating(F.col("prediction")).alias("predicted"),
    )


def train_model(data: TrainingData, name: str, config: ModelConfig = REFERENCE_CONFIG, use_weights: bool = True) -> Model:
    """Fit one of the four regressors on the training side."""
    weight = "weight" if use_weights else None
    return estimator(name, config, label_stats(data.train, "label", weight), weight).fit(data.train)


def train_models(
    data: TrainingData, config: ModelConfig = REFERENCE_CONFIG, use_weights: bool = True, names: Sequence[str] = MODEL_ORDER
) -> dict[str, Model]:
    """Fit the regressors, the linear ones side by side, each in a scheduler pool of its own.

    A linear fit is a row of small jobs, so one alone leaves cores idle between them. The
    pools share the cores evenly if ``spark.scheduler.mode`` is FAIR. The forest and the boosted
    trees follow, each alone: the driver does not hold ridge's sums and the nodes of growing trees at the same time, and
    boosting's short jobs do not wait behind the forest's long tasks. The feature table is
    kept in memory (or on disk, where it does not fit) for all of them.
    """
    context = data.train.sparkSession.sparkContext
    shared = TrainingData(data.train.persist(), data.test, data.manifest, data.featurizer)

    def fit(name: str) -> Model:
        context.setLocalProperty("spark.scheduler.pool", name)
        return train_model(shared, name, config, use_weights)

    alone = [n for n in names if n in TREE_MODELS]
    rounds = [[n for n in names if n not in TREE_MODELS], *([n] for n in alone)]
    found = {}
    try:
        for side_by_side in filter(None, rounds):
            with ThreadPoolExecutor(len(side_by_side)) as threads:
                waiting = {name: threads.submit(inheritable_thread_target(data.train.sparkSession)(fit), name) for name in side_by_side}
                found |= {name: done.result() for name, done in waiting.items()}
        return {name: found[name] for name in names}
    finally:
        shared.train.unpersist()


def compare_models(data: TrainingData, models: Mapping[str, Model]) -> TrainingResult:
    """Predict the test side with each fitted regressor, and pick the lowest RMSE."""
    parts = [predictions_of(model, name, data.test) for name, model in models.items()]
    predictions = settle(reduce(DataFrame.unionByName, parts), "predictions")
    metrics = regression_metrics(predictions)
    best = best_model(metrics, list(models)).first()
    return TrainingResult(dict(models), predictions, metrics, best["model"], best.asDict())


def train_and_compare(
    data: TrainingData,
    config: ModelConfig = REFERENCE_CONFIG,
    use_weights: bool = True,
    names: Sequence[str] = MODEL_ORDER,
) -> TrainingResult:
    """Fit the regressors, predict the test side, pick the lowest RMSE."""
    return compare_models(data, train_models(data, config, use_weights, names))


def unweighted_metrics(data: TrainingData, config: ModelConfig = REFERENCE_CONFIG, names: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Metrics of every model trained without sample weights, marked as such."""
    return train_and_compare(data, config, False, names).metrics.withColumn("weighted", F.lit(False))


def weighted_vs_unweighted(
    data: TrainingData, config: ModelConfig = REFERENCE_CONFIG, names: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """Metrics of every model trained without and with sample weights."""
    weighted = train_and_compare(data, config, True, names).metrics.withColumn("weighted", F.lit(True))
    return unweighted_metrics(data, config, names).unionByName(weighted)
