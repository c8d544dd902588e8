import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.rating import rating_range
from scriptorium.operators import dedup, evaluate, gates, resolve, scale, split, stats, weights
from scriptorium.plans import dataset as D
from scriptorium.schema import METADATA_SCHEMA, RATING_RANGES, Settings


def movie(source, row, file, name="t", rating="5.0", year=None, decade=None, length=None):
    return (source, row, name, year, rating, f"tt{row}", file, "me", decade, length)


def movies(spark, rows):
    return spark.createDataFrame(rows, METADATA_SCHEMA)


def listing(spark, names):
    return spark.createDataFrame([(n,) for n in names], "file_name string")


@pytest.mark.parametrize(
    "ref, files, expected",
    [
        ("a b", ["a-b"], ("a-b", 3)),
        ("a b", ["a_b.txt"], ("a_b.txt", 4)),
        ("a b", ["a b.txt.txt"], ("a b.txt.txt", 5)),
        ("a b", ["a b.txt", "a_b.txt"], ("a b.txt", 1)),
        ("a b", ["a-b.txt", "a-b"], ("a-b.txt", 2)),
        (" x.txt ", ["x.txt"], ("x.txt", 0)),
        ("x 12", ["file12.txt"], ("file12.txt", 10)),
        ("x 12 34", ["file34.txt", "file 12.txt.txt"], ("file 12.txt.txt", 9)),
        ("x12", ["file12.txt", "file 12.txt", "file_12.txt", "file-12.txt"], ("file-12.txt", 6)),
        ("x", ["file.txt", "file1.txt", "nofile-1.txt"], (None, None)),
        (None, ["nan.txt", ".txt"], (None, None)),
        ("  ", [".txt", "file1.txt"], (None, None)),
    ],
)
def test_resolution_order(spark, ref, files, expected):
    out = resolve.resolve_script_files(movies(spark, [movie(0, 1, ref)]), listing(spark, files)).first()
    assert (out.file_name, out.candidate_position) == expected


def test_resolution_keeps_every_row(spark):
    rows = [movie(0, i, None if i % 3 == 0 else f"part 1 of {i}") for i in range(60)]
    out = resolve.resolve_script_files(movies(spark, rows), listing(spark, ["file-1.txt", "part 1 of 7.txt"]))
    got = {r.row_ordinal: r.file_name for r in out.collect()}
    assert len(got) == 60 and got[7] == "part 1 of 7.txt" and got[8] == "file-1.txt" and got[9] is None


def test_hot_name_join_is_split(spark):
    """A name that dominates the join is split by AQE rather than left to one task."""
    rows = spark.range(200_000).select(
        F.lit(0).alias("source_ordinal"), F.col("id").alias("row_ordinal"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("script_file"),
    )
    files = spark.range(200_000).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("file_name"))
    files = files.union(spark.createDataFrame([("hot.txt",)], "file_name string"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = resolve.resolve_script_files(rows, files)
        out.write.format("noop").mode("overwrite").save()
        counted = out.groupBy("file_name").count().where("file_name = 'hot.txt'")
        assert counted.first()["count"] == math.ceil(200_000 / 3)
        out.cache().count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        out.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dedup_first_last_and_null_key(spark):
    df = movies(spark, [movie(1, 0, "a"), movie(0, 5, "a"), movie(0, 2, None), movie(1, 9, None), movie(0, 1, "b")])
    first = {(r.script_file, r.source_ordinal, r.row_ordinal) for r in dedup.keep_first(df).collect()}
    last = {(r.script_file, r.source_ordinal, r.row_ordinal) for r in dedup.keep_last(df).collect()}
    assert first == {("a", 0, 5), (None, 0, 2), ("b", 0, 1)}
    assert last == {("a", 1, 0), (None, 1, 9), ("b", 0, 1)}
    assert sorted(map(tuple, dedup.keep_first(dedup.keep_first(df)).collect()), key=str) == sorted(map(tuple, dedup.keep_first(df).collect()), key=str)
    counts = dedup.duplicate_counts(df).first()
    assert (counts.total_rows, counts.kept_rows, counts.duplicate_rows) == (5, 3, 2)


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = dedup.keep_first(movies(spark, [movie(0, 1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "Partial" in plan[plan.index("Exchange"):]


def test_duplicate_titles_ignore_null(spark):
    df = movies(spark, [movie(0, i, f"f{i}", name=n) for i, n in enumerate(["A", "A", "A", "B", None, None])])
    assert [(r.movie_name, r.n_rows) for r in dedup.duplicate_titles(df).collect()] == [("A", 3)]
    assert dedup.duplicate_title_summary(df).first().extra_rows == 2
    assert dedup.expand_duplicates(df).count() == 3
    empty = dedup.duplicate_title_summary(df.where("movie_name = 'B'")).first()
    assert (empty.names, empty.total_rows, empty.extra_rows) == (0, 0, 0)


def test_outcomes_in_order(spark):
    rows = [movie(0, 1, "ok"), movie(0, 2, "ok2", rating="99"), movie(0, 3, "gone"), movie(0, 4, "tiny"), movie(0, 5, "bad"), movie(0, 6, "gone2", rating="x")]
    files = spark.createDataFrame([("ok.txt", 1000), ("ok2.txt", 5000), ("tiny.txt", 999), ("bad.txt", None)], "file_name string, n_chars int")
    out = {r.script_file: r.outcome for r in gates.with_outcome(movies(spark, rows), files).collect()}
    assert out == {"ok": "loaded", "ok2": "invalid_rating", "gone": "missing", "tiny": "short", "bad": "error", "gone2": "invalid_rating"}
    summary = {r.outcome: r.n_rows for r in stats.load_summary(gates.with_outcome(movies(spark, rows), files)).collect()}
    assert summary == {"loaded": 1, "invalid_rating": 2, "missing": 1, "short": 1, "error": 1, "total": 6}


def test_audit_options(spark):
    rows = [movie(0, 1, "a", name="Same"), movie(0, 2, "b", name="Same", rating="NaN"), movie(0, 3, "c", name="Other")]
    files = spark.createDataFrame([("a.txt", 10)], "file_name string, n_bytes long")
    strict = {(r.row_ordinal, r.reason, r.detail) for r in gates.audit_skipped(movies(spark, rows), files).collect()}
    assert strict == {(1, "too_short", "a.txt (10 bytes)"), (3, "missing", "c.txt")}
    loose = {r.row_ordinal: r.reason for r in gates.audit_skipped(movies(spark, rows), files, by_title=False).collect()}
    assert loose == {1: "too_short", 2: "invalid_rating", 3: "missing"}


def test_document_gate(spark):
    df = spark.range(5)
    assert gates.require_documents(df, Settings(min_documents=5))
    assert not gates.require_documents(df, Settings(min_documents=6), allow_small=True)
    with pytest.raises(ValueError):
        gates.require_documents(df, Settings(min_documents=6))


def test_published_weights(spark):
    counts = [(2.0, 371), (5.0, 1947), (7.0, 1171), (9.0, 147), (0.5, 3), (10.0, 2)]
    df = spark.createDataFrame([(r,) for r, n in counts for _ in range(n)], "rating double")
    got = {r.rating: round(r.weight, 4) for r in weights.sample_weights(df).distinct().collect()}
    assert got == {2.0: 5.248, 5.0: 1.0, 7.0: 1.6627, 9.0: 13.2449, 0.5: 1.0, 10.0: 1.0}
    balanced = weights.range_weights(df).select((F.col("weight") * F.col("n_rows")).alias("x")).collect()
    assert len(balanced) == len(RATING_RANGES) and all(r.x == pytest.approx(1947) for r in balanced)


def test_published_metrics(spark):
    df = spark.createDataFrame([("m", 7.5, 7.2), ("m", 6.0, 8.0), ("m", 8.5, 8.3)], "model string, actual double, predicted double")
    row = evaluate.regression_metrics(df).first()
    assert (round(row.rmse, 4), round(row.mae, 4)) == (1.1733, 0.8333)


def test_metrics_agree_with_spark_ml(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    df = spark.range(500).select(F.lit("m").alias("model"), (F.rand(1) * 9 + 1).alias("actual"), (F.rand(2) * 9 + 1).alias("predicted")).cache()
    row = evaluate.regression_metrics(df).first()
    for name in ("rmse", "mae", "r2"):
        expected = RegressionEvaluator(predictionCol="predicted", labelCol="actual", metricName=name).evaluate(df)
        assert row[name] == pytest.approx(expected, abs=1e-10)
    brackets = [r.n_within for r in evaluate.error_brackets(df, evaluate.EVALUATION_THRESHOLDS).orderBy("threshold").collect()]
    assert brackets == sorted(brackets)


def test_equal_ratings_have_no_r2(spark):
    df = spark.createDataFrame([("m", 5.0, 6.0), ("m", 5.0, 4.0)], "model string, actual double, predicted double")
    assert evaluate.regression_metrics(df).first().r2 is None


def test_best_model_ties_go_to_training_order(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model string, rmse double")
    assert evaluate.best_model(df, ["b", "a", "c"]).first().model == "b"


def test_split_is_stable_and_complete(spark):
    df = spark.range(3000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("k"))
    a = {r.k: r.split for r in split.train_test_split(df, "k").collect()}
    b = {r.k: r.split for r in split.train_test_split(df.orderBy(F.desc("k")).repartition(5), "k").collect()}
    assert a == b and len(a) == 3000 and set(a.values()) == {"train", "test"}
    assert 0.27 < sum(v == "test" for v in a.values()) / 3000 < 0.33


@pytest.mark.parametrize("n, expected", [(1, 1), (10, 3), (11, 4), (5195, 1559)])
def test_exact_split_sizes(spark, n, expected):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    sides = split.exact_train_test_split(df, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sides}.get("test") == expected


def test_decade_codes_and_unknown(spark):
    df = spark.createDataFrame([("2000s",), ("1990s",), ("2000s",), ("1970s",)], "decade string")
    codes = scale.decade_codes(df)
    assert {r.decade: r.decade_encoded for r in codes.collect()} == {"1970s": 0, "1990s": 1, "2000s": 2}
    other = spark.createDataFrame([("2000s",), ("1800s",), (None,)], "decade string")
    assert [r.decade_encoded for r in scale.encode_decades(other, codes).orderBy("decade").collect()] == [0, 0, 2]


def test_scaler_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = scale.fit_scaler(df, ["a", "b"])
    assert [tuple(r) for r in scaler.transform(df).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert scale.Scaler.from_table(scaler.to_table(spark)) == scaler


def test_lookup_last_row_wins(spark):
    df = movies(spark, [movie(0, 1, "a", year="1990", decade="1990s", length="90"), movie(1, 1, " a.txt", year="1991", decade="1980s", length="-1")])
    lookup = D.metadata_by_file(df)
    codes = scale.decade_codes(lookup)
    out = D.lookup_metadata(listing(spark, ["a.txt", "z.txt"]), lookup, codes).orderBy("file_name").collect()
    assert [(r.year, r.decade_encoded, r.movie_length) for r in out] == [(1991, 0, 120.0), (2020, 0, 120.0)]
    assert rating_range(F.lit(1.0)) is not None
