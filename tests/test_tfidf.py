import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from scriptorium.functions.stopwords import ENGLISH_STOP_WORDS
from scriptorium.operators import tfidf as TF
from scriptorium.plans import dataset
from scriptorium.plans.training import training_tasks
from scriptorium.schema import DEFAULTS, Settings

TEXTS = {
    1: "the red fox and the red hen. red red red",
    2: "red fox ran fast, fast fast fast",
    3: "hen sat still",
    4: "",
    5: "x y z the of",
    6: "red hen fox " * 40,
    7: "solo",
}
SMALL = Settings(min_df=2, max_df=0.9, max_features=5)


@pytest.fixture(scope="module")
def terms(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, clean string")
    return TF.with_terms(df).select("id", "terms").cache()


def py_terms(text):
    import re

    tokens = [t for t in re.findall(r"[a-z0-9_]{2,}", text) if t not in ENGLISH_STOP_WORDS]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def py_fit(texts, settings):
    counts = {k: Counter(py_terms(t)) for k, t in texts.items()}
    n, df, tf = len(texts), Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        tf.update(c)
    kept = [t for t in df if settings.min_df <= df[t] <= settings.max_df * n]
    vocab = sorted(kept, key=lambda t: (-tf[t], t))[: settings.max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    return counts, idf


def py_weights(counts, idf):
    out = {}
    for k, c in counts.items():
        w = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(k, t): v / norm for t, v in w.items()})
    return out


def test_stop_list_is_sparks(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_terms_and_counts(spark, terms):
    got = {r.id: r.terms for r in terms.collect()}
    assert got == {k: py_terms(t) for k, t in TEXTS.items()}
    counted = {(r.id, r.term): r.tf for r in TF.term_counts(terms, "id").collect()}
    assert counted == {(k, t): n for k, text in TEXTS.items() for t, n in Counter(py_terms(text)).items()}


def test_long_run_of_one_term(spark):
    df = spark.createDataFrame([(1, "echo " * 50_000)], "id int, clean string")
    counted = {r.term: r.tf for r in TF.term_counts(TF.with_terms(df), "id").collect()}
    assert counted == {"echo": 50_000, "echo echo": 49_999}


def test_term_counts_do_not_shuffle(spark, terms):
    df = spark.createDataFrame([(1, "a b")], "id int, clean string")
    plan = TF.term_counts(TF.with_terms(df), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_form_weights(spark, terms):
    counts = TF.term_counts(terms, "id")
    vocab = TF.vocabulary(counts, len(TEXTS), SMALL)
    got = {(r.id, r.term): r.weight for r in TF.tfidf(counts, vocab, "id", SMALL).collect()}
    expected = py_weights(*py_fit(TEXTS, SMALL))
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_vectors_equal_long_form(spark, terms):
    model = TF.fit_tfidf(terms, "id", SMALL)
    counts, idf = py_fit(TEXTS, SMALL)
    assert set(model.terms) == set(idf)
    expected = py_weights(counts, idf)
    for row in model.transform(terms).collect():
        vector = row.tfidf.toArray()
        for i, term in enumerate(model.terms):
            assert vector[i] == pytest.approx(expected.get((row.id, term), 0.0), abs=1e-12)
        assert np.linalg.norm(vector) == pytest.approx(1.0) or not vector.any()
    assert TF.TfidfModel.from_table(model.to_table(spark)) == model


def test_unseen_text_drops_unknown_terms(spark, terms):
    model = TF.fit_tfidf(terms, "id", SMALL)
    new = TF.with_terms(spark.createDataFrame([(1, "unknown words"), (2, "red unknown")], "id int, clean string"))
    rows = {r.id: r.tfidf for r in model.transform(new).collect()}
    assert rows[1].numNonzeros() == 0 and rows[2].numNonzeros() == 1


def test_transform_is_narrow_and_runs_no_job(spark, terms):
    model = TF.fit_tfidf(terms, "id", SMALL)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    out = model.transform(terms.select("id", "terms"))
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_empty_vocabulary_is_an_error(spark):
    df = TF.with_terms(spark.createDataFrame([(1, "abc")], "id int, clean string"))
    with pytest.raises(ValueError):
        TF.fit_tfidf(df, "id")


def test_combined_long_form(spark, terms):
    weights = spark.createDataFrame([(1, "red", 0.5)], "id int, term string, weight double")
    numeric = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, n double")
    rows = {(r.id, r.feature): r.value for r in TF.combine_long(weights, numeric, "id", ["n"]).collect()}
    assert rows == {(1, "term:red"): 0.5, (1, "n"): 2.0, (2, "n"): 3.0}
    assert F is not None


def test_weights_shuffle_the_documents_alone(spark):
    """The counts are not shuffled: neither for the join with the vocabulary nor for a row's length."""
    docs = spark.createDataFrame([(i, "red fox runs fast over the hill") for i in range(20)], "doc_id long, clean string")
    dealt = dataset.partitioned(docs, replace(DEFAULTS, text_partitions=4), "doc_id")
    counts = TF.term_counts(TF.with_terms(dealt), "doc_id")
    vocab = spark.createDataFrame([("fox", 1.0), ("red fox", 1.5)], "term string, idf double")
    plan = TF.tfidf(counts, vocab, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_tasks_follow_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(100)
    assert dataset.partitioned(docs, replace(DEFAULTS, text_partitions=2)).rdd.getNumPartitions() == 4 * cores
    assert training_tasks(10**9, cores) == 3 * cores and training_tasks(2001, cores) == 2 and training_tasks(0, cores) == 1


def test_only_terms_of_leading_words_are_counted(spark, monkeypatch):
    """The vocabulary is that of all terms; bigrams of rarer words are not counted, and none is made over a gap."""
    draw = random.Random(1)
    texts = [" ".join(f"w{min(int(draw.expovariate(0.1)), 99)}x" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, clean string")
    settings = replace(SMALL, max_features=20, min_df=2, max_df=0.9)
    counts = TF.term_counts(TF.with_terms(docs), "id")
    want = TF.vocabulary(counts, len(texts), settings).collect()
    counted, vocabulary = [], TF.vocabulary

    def counting(found, *rest):
        counted.append(found.count())
        return vocabulary(found, *rest)

    monkeypatch.setattr(TF, "vocabulary", counting)
    assert sorted(TF.fit_vocabulary(docs, "id", settings).collect()) == sorted(want)
    assert counted[0] < 0.9 * counts.count()
