"""The entry points: audit, train, evaluate and score from paths to paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.dedup import duplicate_counts, duplicate_title_summary, duplicate_titles, expand_duplicates
from scriptorium.operators.evaluate import prediction_analysis
from scriptorium.operators.gates import audit_skipped, missing_files, require_documents
from scriptorium.operators.stats import load_summary, rating_stats, rating_stats_by_source, split_summary
from scriptorium.plans.dataset import label_dataset, load_dataset
from scriptorium.plans.model_store import load_model, save_model
from scriptorium.plans.models import REFERENCE_CONFIG, ModelConfig
from scriptorium.plans.scoring import ScoringModel, absent_test_files, count_existing, evaluate_test_set, scoring_report
from scriptorium.plans.training import TrainingResult, prepare_training, train_and_compare
from scriptorium.schema import DEFAULTS, Settings
from scriptorium.session import held, run_folder
from scriptorium.sources.corpus import pack_corpus, read_corpus, read_packed_corpus
from scriptorium.sources.manifest import read_split_manifest, write_split_manifest
from scriptorium.sources.metadata import path_exists, read_metadata
from scriptorium.streaming.scoring import start_scoring


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A packed corpus (``.parquet``) or a folder of text files."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no corpus at {path}")
    packed = path.rstrip("/").endswith(".parquet")
    return read_packed_corpus(spark, path) if packed else read_corpus(spark, path)


def run_audit(
    spark: SparkSession, metadata: str | list[str], corpus_path: str, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Data-quality reports: ratings, duplicates, load outcomes, skipped and missing files."""
    movies, corpus = read_metadata(spark, metadata), open_corpus(spark, corpus_path)
    listing = corpus.select("file_name", "n_bytes")
    return {
        "ratings_by_source": rating_stats_by_source(movies, "source_path"),
        "duplicate_files": duplicate_counts(movies),
        "duplicate_titles": duplicate_titles(movies).orderBy(F.desc("n_rows"), "movie_name"),
        "duplicate_title_summary": duplicate_title_summary(movies),
        "duplicate_title_rows": expand_duplicates(movies),
        "load_summary": load_summary(label_dataset(movies, corpus, settings)),
        "skipped": audit_skipped(movies, listing, settings),
        "missing_files": missing_files(movies, listing),
    }


def run_training(
    spark: SparkSession,
    metadata: str | list[str],
    corpus_path: str,
    model_path: str,
    manifest_path: str,
    settings: Settings = DEFAULTS,
    config: ModelConfig = REFERENCE_CONFIG,
    use_weights: bool = True,
    exact_split: bool = False,
    allow_small: bool = False,
) -> tuple[TrainingResult, dict[str, DataFrame]]:
    """Load, split, train and compare; save the best model, its predictions and the split manifest.

    Tables on the way lie in one run folder that is gone at the end; what stays is
    below ``model_path`` and ``manifest_path``.
    """
    with run_folder(spark):
        dataset = load_dataset(read_metadata(spark, metadata), open_corpus(spark, corpus_path), settings)
        data = prepare_training(dataset, settings, exact=exact_split)
        require_documents(data.manifest, settings, allow_small)
        write_split_manifest(data.manifest, manifest_path, settings)
        result = train_and_compare(data, config, use_weights)
        best = ScoringModel(result.best, result.models[result.best], data.featurizer, result.best_metrics, settings)
        save_model(best, spark, model_path)
        result.predictions.write.mode("overwrite").parquet(f"{model_path}/predictions")
        result.predictions, result.metrics = spark.read.parquet(f"{model_path}/predictions"), held(result.metrics)
        reports = {
            "split": split_summary(data.manifest),
            "ratings": rating_stats(data.manifest),
            **prediction_analysis(result.predictions, model=result.best),
        }
        # all of them are summaries or samples of a fixed size
        reports = {"metrics": result.metrics, **{name: held(report) for name, report in reports.items()}}
    return result, reports


def run_evaluation(
    spark: SparkSession,
    metadata: str | list[str],
    corpus_path: str,
    model_path: str,
    manifest_path: str,
    settings: Settings = DEFAULTS,
) -> dict[str, DataFrame]:
    """Score the saved test documents with their metadata and report the errors."""
    scorer = load_model(spark, model_path, settings)
    manifest = read_split_manifest(spark, manifest_path)
    movies, corpus = read_metadata(spark, metadata), open_corpus(spark, corpus_path)
    reports = evaluate_test_set(manifest, movies, corpus, scorer.featurizer.decades, scorer)
    return {"files": count_existing(manifest, corpus), "skipped": absent_test_files(manifest, corpus), **reports}


def write_reports(reports: dict[str, DataFrame], output: str) -> None:
    """Every report in full, one Parquet folder each."""
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{name}")


def run_packing(spark: SparkSession, corpus_path: str, output: str, files: int | None = None) -> DataFrame:
    """Pack a folder of text files into one table of about equal files."""
    pack_corpus(spark, corpus_path, output, files=files)
    return read_packed_corpus(spark, output).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def run_stream(
    spark: SparkSession, corpus_path: str, model_path: str, output: str, checkpoint: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Score the files that have arrived since the last run, and append them to ``output``."""
    start_scoring(spark, corpus_path, load_model(spark, model_path, settings), output, checkpoint).awaitTermination()
    return spark.read.parquet(output)


def run_scoring(
    spark: SparkSession, corpus_path: str, model_path: str, output: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Score every document of a corpus and write the report as parquet."""
    scorer = load_model(spark, model_path, settings)
    scoring_report(open_corpus(spark, corpus_path), scorer).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
