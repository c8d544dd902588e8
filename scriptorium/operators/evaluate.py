"""Error measures over ``model, script_file, actual, predicted`` tables.

Each report is one aggregation with map-side partial sums; its result has a few
rows per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.rating import rating_range
from scriptorium.schema import DEFAULTS

# --- fixed values: error thresholds of the two reports -----------------------
TRAINING_THRESHOLDS = (0.5, 1.0, 1.5, 2.0)
EVALUATION_THRESHOLDS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


def _error():
    return F.col("predicted") - F.col("actual")


def join_actual_predicted(actual: DataFrame, predicted: DataFrame, key: str = "script_file") -> DataFrame:
    """Pair true and predicted ratings by document key."""
    return actual.join(predicted, key, "inner")


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE, MAE, R2 and row count per model; R2 is NULL if all ratings are equal."""
    error = _error()
    spread = F.count(F.lit(1)) * F.var_pop("actual")
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1.0 - F.sum(error * error) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def error_brackets(predictions: DataFrame, thresholds: Sequence[float] = TRAINING_THRESHOLDS) -> DataFrame:
    """Per model and threshold: predictions within it, as count and percent."""
    size = F.abs(_error())
    counts = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count_if(size <= t).alias(f"_within_{i}") for i, t in enumerate(thresholds)),
    )
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_within_{i}").alias("n_within"))
        for i, t in enumerate(thresholds)
    ]
    return counts.select("model", "n_rows", F.inline(F.array(*rows))).select(
        "model", "threshold", "n_within", (F.col("n_within") * 100.0 / F.col("n_rows")).alias("percent")
    )


def mae_by_range(predictions: DataFrame) -> DataFrame:
    """Mean absolute error and count per model and true-rating range."""
    ranged = predictions.withColumn("rating_range", rating_range(F.col("actual")))
    ranged = ranged.where(F.col("rating_range").isNotNull())
    return ranged.groupBy("model", "rating_range").agg(
        F.avg(F.abs(_error())).alias("mae"), F.count(F.lit(1)).alias("n_rows")
    )


def best_model(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """The row with the lowest RMSE; ties go to the model trained first."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return metrics.orderBy("rmse", rank).limit(1)


def sample_predictions(predictions: DataFrame, key: str = "script_file", n: int = 15, seed: int = DEFAULTS.seed) -> DataFrame:
    """``n`` rows drawn without replacement by a seeded hash of the key."""
    draw = F.md5(F.concat(F.col(key), F.lit(f"#{seed}")))
    picked = predictions.orderBy(draw, F.col(key)).limit(n)
    return picked.select(key, "actual", "predicted", _error().alias("error"))


def first_predictions(predictions: DataFrame, key: str = "script_file", name: str = "movie_name", n: int = 20) -> DataFrame:
    """The first ``n`` rows by key, titles shortened to 28 characters."""
    first = predictions.orderBy(key).limit(n)
    return first.select(
        key,
        F.substring(F.coalesce(F.col(name), F.lit("Unknown")), 1, 28).alias(name),
        "actual",
        "predicted",
        F.abs(_error()).alias("error"),
    )


def prediction_analysis(predictions: DataFrame, key: str = "script_file", model: str | None = None) -> dict[str, DataFrame]:
    """The detailed report of one model: brackets, sample, and error by range."""
    chosen = predictions.where(F.col("model") == model) if model else predictions
    return {
        "error_brackets": error_brackets(chosen),
        "sample_predictions": sample_predictions(chosen, key),
        "mae_by_range": mae_by_range(chosen),
    }
