"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every
job is written in full to Spark's no-op sink. ``prepare_training`` is loading,
splitting and feature fitting. All four regressors train at their full published
size; the scoring jobs use ridge. The two tree models share
``BENCH_TRAIN_SECONDS``: one that does not end in time is stopped and reported
under ``unfinished`` with the seconds it had.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from pyspark.sql import functions as F

from scriptorium.catalog import queries
from scriptorium.catalog.training_runs import SETTINGS, corpus, movies, training
from scriptorium.catalog.views import table
from scriptorium.functions.text import clean_text, text_features
from scriptorium.plans.dataset import load_dataset, partitioned
from scriptorium.plans.models import ELASTIC_NET, GRADIENT_BOOSTING, RANDOM_FOREST, REFERENCE_CONFIG, RIDGE
from scriptorium.plans.scoring import ScoringModel, evaluate_test_set, predict, scoring_report
from scriptorium.plans.training import train_model
from scriptorium.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

RELATIONAL = (
    "dedup_keep_first", "dedup_two_keys", "expand_duplicates", "resolve_script_files", "skip_reason", "audit_skipped",
    "sample_weights", "regression_metrics", "error_brackets", "mae_by_range",
)
TEXT = ("clean_text", "text_features", "term_counts", "vocabulary_topk", "tfidf", "vectorize", "standard_scale")
TRAIN_SECONDS = int(os.environ.get("BENCH_TRAIN_SECONDS", "300"))


def clean_and_features(spark):
    docs = partitioned(table(spark, SF_DIR, "documents").select("doc_id", "text"), SETTINGS)
    return text_features(docs).withColumn("clean", clean_text(F.col("text"))).drop("text")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(seconds: dict, name: str, job) -> None:
    start = time.perf_counter()
    job()
    seconds[name] = round(time.perf_counter() - start, 3)
    print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)


def train_trees(spark, data, seconds: dict) -> dict:
    """Time both tree models at full size; those stopped by the limit come back with their seconds."""

    def stop(*_):
        raise TimeoutError

    signal.signal(signal.SIGALRM, stop)
    unfinished, end = {}, time.monotonic() + TRAIN_SECONDS
    for name, label in ((RANDOM_FOREST, "train_random_forest"), (GRADIENT_BOOSTING, "train_gbt")):
        started = time.monotonic()
        signal.alarm(max(1, int(end - started)))
        try:
            timed(seconds, label, lambda: train_model(data, name, REFERENCE_CONFIG))
        except Exception as error:  # the alarm may surface inside the gateway's call
            if time.monotonic() < end - 1:
                raise
            unfinished[label] = round(time.monotonic() - started, 1)
            print(f"{label}: stopped ({type(error).__name__})", file=sys.stderr, flush=True)
            spark.sparkContext.cancelAllJobs()
        finally:
            signal.alarm(0)
    return unfinished


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = queries(), {}
    drain(table(spark, SF_DIR, "documents"))  # start the JVM's readers before timing
    timed(seconds, "clean_and_features", lambda: drain(clean_and_features(spark)))
    timed(seconds, "load_dataset", lambda: drain(load_dataset(movies(spark, SF_DIR), corpus(spark, SF_DIR), SETTINGS)))
    for name in (*RELATIONAL, *TEXT):
        timed(seconds, name, lambda: drain(found[name](spark, SF_DIR)))
    made = {}
    timed(seconds, "prepare_training", lambda: made.update(data=training(spark, SF_DIR)))
    data = made["data"]
    for name, label in ((RIDGE, "train_ridge"), (ELASTIC_NET, "train_elastic_net")):
        timed(seconds, label, lambda: made.update({label: train_model(data, name, REFERENCE_CONFIG)}))
    scorer = ScoringModel(RIDGE, made["train_ridge"], data.featurizer)
    inputs = partitioned(corpus(spark, SF_DIR), SETTINGS)
    timed(seconds, "batch_predict", lambda: drain(predict(inputs, scorer)))
    timed(seconds, "scoring_report", lambda: drain(scoring_report(inputs, scorer)))
    reports = evaluate_test_set(data.manifest, movies(spark, SF_DIR), corpus(spark, SF_DIR), data.featurizer.decades, scorer)
    timed(seconds, "evaluate_test_set", lambda: drain(reports["metrics"]))
    unfinished = train_trees(spark, data, seconds)
    documents = table(spark, SF_DIR, "documents").count()
    rates = {n: round(documents / seconds[n], 1) for n in ("clean_and_features", "tfidf", "batch_predict")}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "documents_per_second": rates,
                "unfinished": unfinished,
            }
        )
    )


if __name__ == "__main__":
    main()
