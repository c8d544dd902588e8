"""Closed forms for the linear models, and invariants of training and scoring."""

import numpy as np
import pytest
from conftest import SMALL_CONFIG
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scriptorium.catalog.training_runs import compared, corpus, movies, scorer, training, training_result, written_corpus, written_manifest, written_model
from scriptorium.operators.split import train_test_split
from scriptorium.plans import models as M
from scriptorium.plans import scoring as S
from scriptorium.plans.dataset import label_dataset, load_dataset
from scriptorium.plans.model_store import load_model
from scriptorium.plans.training import train_model, weighted_vs_unweighted
from scriptorium.schema import NUMERIC_FEATURES
from scriptorium.session import new_path
from scriptorium.sources import manifest as SM
from scriptorium.catalog.text_files import write_corpus
from scriptorium.sources.corpus import list_corpus, pack_corpus, read_corpus, read_packed_corpus
from scriptorium.streaming.scoring import start_scoring

TIGHT = M.ModelConfig(linear_iterations=2000, linear_tolerance=1e-12)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5)) * [1, 2, 0.5, 1, 3]
    y = x @ [1.0, -0.5, 0.0, 2.0, 0.1] + 5 + rng.normal(size=300)
    w = rng.choice([1.0, 1.66, 5.25, 13.24], size=300)
    rows = [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).cache(), x, y, w


@pytest.mark.parametrize("weight", [None, "weight"])
def test_ridge_matches_closed_form(regression, weight):
    df, x, y, w = regression
    w = w if weight else np.ones(len(y))
    model = M.estimator(M.RIDGE, TIGHT, M.label_stats(df, "label", weight), weight).fit(df)
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    b = np.linalg.solve(xc.T @ (xc * w[:, None]) + 1.5 * np.eye(5), xc.T @ (yc * w))
    assert model.coefficients.toArray() == pytest.approx(b, abs=1e-6)
    assert model.intercept == pytest.approx(my - mx @ b, abs=1e-6)


@pytest.mark.parametrize("weight", [None, "weight"])
def test_elastic_net_matches_coordinate_descent(regression, weight):
    df, x, y, w = regression
    w = w if weight else np.ones(len(y))
    model = M.estimator(M.ELASTIC_NET, TIGHT, M.label_stats(df, "label", weight), weight).fit(df)
    total = w.sum()
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc, b = x - mx, y - my, np.zeros(5)
    for _ in range(2000):
        for j in range(5):
            r = yc - xc @ b + xc[:, j] * b[j]
            rho = (w * xc[:, j] * r).sum() / total
            b[j] = np.sign(rho) * max(abs(rho) - 0.05, 0) / ((w * xc[:, j] ** 2).sum() / total + 0.05)
    assert model.coefficients.toArray() == pytest.approx(b, abs=1e-5)


def test_loaded_documents_equal_the_labels(spark, sf_dir):
    loaded = load_dataset(movies(spark, sf_dir), corpus(spark, sf_dir))
    labels = label_dataset(movies(spark, sf_dir), corpus(spark, sf_dir)).where("outcome = 'loaded'")
    keys = labels.select(F.concat_ws(":", "source_ordinal", "row_ordinal").alias("doc_key"), "file_name")
    assert sorted(map(tuple, loaded.select("doc_key", "file_name").collect())) == sorted(map(tuple, keys.collect()))
    assert loaded.where("year is null or movie_length is null or decade is null").count() == 0


def test_only_matched_documents_are_cleaned(spark, sf_dir):
    """Patterns over texts stand above the join of documents with their metadata."""
    plan = load_dataset(movies(spark, sf_dir), corpus(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert "AS clean" in plan and "AS clean" not in below and "AS sentence_count" not in below
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_training_data(spark, sf_dir):
    data = training(spark, sf_dir)
    sides = {r.split: r.n for r in data.manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sides["train"] == data.train.count() and sides["test"] == data.test.count()
    assert data.train.join(data.test, "file_name").count() == 0
    width = len(data.featurizer.tfidf.terms) + len(NUMERIC_FEATURES)
    assert data.test.first().features.size == width
    numeric = np.array([r.features.toArray()[-len(NUMERIC_FEATURES):] for r in data.train.collect()])
    assert np.abs(numeric.mean(axis=0)).max() < 1e-9
    assert {round(float(s), 6) for s in numeric.std(axis=0)} <= {0.0, 1.0}


def test_compare_picks_lowest_rmse(spark, sf_dir):
    result = training_result(spark, sf_dir)
    metrics = {r.model: r.rmse for r in result.metrics.collect()}
    assert set(metrics) == set(M.MODEL_ORDER) and metrics[result.best] == min(metrics.values())
    assert result.predictions.where("predicted < 1 or predicted > 10").count() == 0


def test_weights_flag_changes_the_fit(spark, sf_dir):
    data = training(spark, sf_dir)
    fits = [train_model(data, M.RIDGE, use_weights=flag).coefficients.toArray() for flag in (True, False)]
    assert np.abs(fits[0] - fits[1]).max() > 1e-3
    runs = weighted_vs_unweighted(data, SMALL_CONFIG, [M.RIDGE]).collect()
    assert sorted(r.weighted for r in runs) == [False, True]


def test_model_round_trip(spark, sf_dir):
    result = compared(spark, sf_dir, M.RIDGE)
    loaded = load_model(spark, written_model(spark, sf_dir))
    assert loaded.name == result.best and loaded.metrics["rmse"] == result.best_metrics["rmse"]
    original = S.ScoringModel(result.best, result.models[result.best], training(spark, sf_dir).featurizer)
    inputs = corpus(spark, sf_dir)
    a = {r.file_name: r.predicted_rating for r in S.predict(inputs, loaded).collect()}
    b = {r.file_name: r.predicted_rating for r in S.predict(inputs, original).collect()}
    assert a == b and all(1 <= v <= 10 for v in a.values())
    with pytest.raises(FileNotFoundError):
        load_model(spark, new_path(spark, "nothing"))


def test_training_and_serving_features_agree(spark, sf_dir):
    """Scoring a test document with its own metadata repeats the training prediction."""
    result = compared(spark, sf_dir, M.RIDGE)
    model = scorer(spark, sf_dir)
    loaded = load_dataset(movies(spark, sf_dir), corpus(spark, sf_dir))
    meta = train_test_split(loaded, "file_name").where("split = 'test'").join(model.featurizer.decades, "decade", "left")
    inputs = meta.select("file_name", "doc_key", "year", "movie_length", "decade_encoded").join(corpus(spark, sf_dir), "file_name")
    scored = {r.doc_key: r.prediction for r in S.predict(inputs, model).collect()}
    trained = {r.doc_key: r.predicted for r in result.predictions.where(F.col("model") == result.best).collect()}
    assert scored.keys() == trained.keys()
    assert all(min(max(scored[k], 1), 10) == pytest.approx(trained[k], abs=1e-9) for k in scored)


def test_scoring_report_keeps_rejected_rows(spark, sf_dir):
    rows = [("a.txt", "word " * 50), ("b.txt", "short"), ("c.pdf", "word " * 50), ("d.txt", None), ("e.txt", " " * 500)]
    df = spark.createDataFrame(rows, "file_name string, text string")
    out = {r.file_name: r for r in S.scoring_report(df, scorer(spark, sf_dir)).collect()}
    assert len(out) == 5
    assert out["a.txt"].error is None and out["a.txt"].message == (
        f"Predicted rating for 'a.txt': {out['a.txt'].predicted_rating}/10 ({out['a.txt'].rating_category})")
    assert out["c.pdf"].error == "only .txt files are supported"
    for name in ("b.txt", "d.txt", "e.txt"):
        assert out[name].error == "text is too short" and out[name].predicted_rating is None and out[name].message is None


def test_predict_text(spark, sf_dir):
    rows = S.predict_text(spark, ["JOHN: Hello!\nMARY: Hi there!", ""], scorer(spark, sf_dir)).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1] and rows[0].year == 2020 and rows[0].movie_length == 120.0


def test_evaluation_reports(spark, sf_dir):
    manifest = SM.read_split_manifest(spark, written_manifest(spark, sf_dir))
    model = scorer(spark, sf_dir)
    reports = S.evaluate_test_set(manifest, movies(spark, sf_dir), corpus(spark, sf_dir), model.featurizer.decades, model)
    n_test = manifest.where("split = 'test'").count()
    assert reports["metrics"].first().n_rows == n_test == reports["predictions"].count()
    assert reports["error_brackets"].count() == 6 and reports["first_predictions"].count() == min(20, n_test)
    listing = corpus(spark, sf_dir).select("file_name")
    row = S.count_existing(manifest, listing).first()
    assert (row.n_documents, row.n_existing) == (n_test, n_test)


def test_manifest(spark, sf_dir):
    path = written_manifest(spark, sf_dir)
    whole = SM.read_split_manifest(spark, path)
    assert SM.read_run(spark, path) == {"total_samples": whole.count(), "test_size": 0.3, "random_state": 42}
    test = SM.read_split_manifest(spark, path, "test")
    assert "split=test" in "".join(test.inputFiles()) and "split=train" not in test._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[0]
    with pytest.raises(FileNotFoundError):
        SM.read_split_manifest(spark, new_path(spark, "none"))
    old = new_path(spark, "old")
    whole.drop("script_file").write.partitionBy("split").parquet(f"{old}/documents")
    with pytest.raises(ValueError):
        SM.read_split_manifest(spark, old)


def test_corpus_files_round_trip(spark):
    folder = new_path(spark, "files")
    contents = {"a.txt": b"caf\xe9\r\nx\ry", "b c+%41.txt": "café".encode(), "skip.bin": b"zz", "e.txt": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "file_name string, content binary")
    assert write_corpus(df, folder) == 4
    got = {r.file_name: r.text for r in read_corpus(spark, folder).collect()}
    assert got == {"a.txt": "café\nx\ny", "b c+%41.txt": "café"}  # zero bytes: passed over
    packed = new_path(spark, "packed")
    pack_corpus(spark, folder, packed)
    assert {r.file_name: r.text for r in read_packed_corpus(spark, packed).collect()} == got
    sizes = {r.file_name: r.n_bytes for r in list_corpus(spark, folder).collect()}
    assert sizes == {"a.txt": 9, "b c+%41.txt": 5}
    plan = list_corpus(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_stream_equals_batch(spark, sf_dir):
    folder, model = written_corpus(spark, sf_dir), scorer(spark, sf_dir)
    output, checkpoint = new_path(spark, "scored"), new_path(spark, "ckpt")
    start_scoring(spark, folder, model, output, checkpoint, files_per_batch=60).awaitTermination()
    stream = sorted(map(tuple, spark.read.parquet(output).select("file_name", "predicted_rating", "error").collect()))
    batch = S.scoring_report(read_corpus(spark, folder), model).select("file_name", "predicted_rating", "error")
    assert stream == sorted(map(tuple, batch.collect())) and len(stream) == corpus(spark, sf_dir).count()
    # a second start finds nothing new, and a late file is scored alone
    start_scoring(spark, folder, model, output, checkpoint).awaitTermination()
    assert spark.read.parquet(output).count() == len(stream)
    late = spark.createDataFrame([("late.txt", bytearray(b"words " * 100))], "file_name string, content binary")
    extra = new_path(spark, "late")
    write_corpus(late, extra)
    start_scoring(spark, extra, model, new_path(spark, "o"), new_path(spark, "c")).awaitTermination()
