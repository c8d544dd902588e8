"""Atomic model versions, and forests cut to a minimum split size."""

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

from scriptorium.catalog.training_runs import compared, training
from scriptorium.plans import model_store as MS
from scriptorium.plans import models as M
from scriptorium.plans.pruning import cut_small_splits, with_min_split
from scriptorium.plans.scoring import ScoringModel
from scriptorium.session import new_path


@pytest.fixture(scope="module")
def scorers(spark, sf_dir):
    result = compared(spark, sf_dir, M.RIDGE)
    featurizer = training(spark, sf_dir).featurizer
    return [ScoringModel(name, result.models[M.RIDGE], featurizer, result.best_metrics) for name in ("one", "two", "three")]


def test_a_crash_between_writes_leaves_the_old_model(spark, scorers, monkeypatch):
    path = new_path(spark, "model")
    first = MS.save_model(scorers[0], spark, path)

    def crash(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(MS, "_commit", crash)
    with pytest.raises(RuntimeError):
        MS.save_model(scorers[1], spark, path)
    assert MS.load_model(spark, path).name == "one" and MS.model_versions(spark, path) == [first]
    monkeypatch.setattr(MS, "parts_digest", crash)  # earlier still: parts are written, no record exists
    with pytest.raises(RuntimeError):
        MS.save_model(scorers[1], spark, path)
    monkeypatch.undo()
    assert MS.load_model(spark, path).name == "one"
    second = MS.save_model(scorers[1], spark, path)
    assert MS.load_model(spark, path).name == "two" and MS.load_model(spark, path, version=first).name == "one"
    third = MS.save_model(scorers[2], spark, path)
    assert MS.model_versions(spark, path) == [second, third]
    with pytest.raises(FileNotFoundError):
        MS.load_model(spark, path, version=first)


def test_a_damaged_version_is_no_model(spark, scorers):
    path = new_path(spark, "model")
    version = MS.save_model(scorers[0], spark, path)
    spark.createDataFrame([(1,)], "x int").write.mode("append").parquet(f"{path}/versions/{version}/scaler")
    with pytest.raises(ValueError, match="not whole"):
        MS.load_model(spark, path)
    with pytest.raises(FileNotFoundError):
        MS.load_model(spark, new_path(spark, "none"))


def test_forest_cut_at_a_minimum_split_size(spark):
    rng = random.Random(3)
    rows = [(Vectors.dense([rng.random(), float(rng.randrange(4)), rng.gauss(0, 1)]), rng.random() * 9) for _ in range(150)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = RandomForestRegressor(numTrees=7, maxDepth=12, minInstancesPerNode=1, seed=5).fit(df)
    grown = new_path(spark, "forest")
    model.write().save(grown)
    table = spark.read.parquet(f"{grown}/data")
    trees = {}
    for r in table.collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData

    def walk(nodes, x):  # a plain walk that stops at small nodes
        at = nodes[0]
        while at.leftChild >= 0 and at.rawCount >= 5:
            at = nodes[at.leftChild if x[at.split.featureIndex] <= at.split.leftCategoriesOrThreshold[0] else at.rightChild]
        return at.prediction

    cut = with_min_split(model, spark, 5)
    assert isinstance(cut, RandomForestRegressionModel) and cut.getNumTrees == 7
    want = [sum(walk(t, x) for t in trees.values()) / 7 for x, _ in rows]
    assert [r.prediction for r in cut.transform(df).collect()] == pytest.approx(want, abs=1e-12)
    left = [r.nodeData for r in cut_small_splits(table, 5).collect()]
    assert not any(n.leftChild >= 0 and n.rawCount < 5 for n in left) and len(left) < sum(map(len, trees.values()))
    assert with_min_split(model, spark, 2) is model
