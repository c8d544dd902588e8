"""The four jobs, from files to files."""

from pathlib import Path

import pytest
from conftest import SMALL_CONFIG

from scriptorium.catalog.training_runs import written_corpus
from scriptorium.catalog.views import view
from scriptorium.plans import scoring as S
from scriptorium.plans.jobs import open_corpus, run_audit, run_evaluation, run_packing, run_scoring, run_stream, run_training, write_reports
from scriptorium.plans.model_store import load_model
from scriptorium.session import new_path
from scriptorium.sources.corpus import pack_corpus


@pytest.fixture(scope="module")
def paths(spark, sf_dir):
    base = new_path(spark, "jobs")
    for name in ("movies_a", "movies_b"):
        view(spark, sf_dir, name).drop("source_ordinal").write.parquet(f"{base}/{name}.parquet")
    folder = written_corpus(spark, sf_dir)
    pack_corpus(spark, folder, f"{base}/corpus.parquet")
    return {
        "metadata": [f"{base}/movies_a.parquet", f"{base}/none.parquet", f"{base}/movies_b.parquet"],
        "folder": folder, "packed": f"{base}/corpus.parquet", "model": f"{base}/model", "manifest": f"{base}/manifest", "base": base,
    }


def test_audit(spark, paths):
    reports = run_audit(spark, paths["metadata"], paths["packed"])
    outcomes = {r.outcome: r.n_rows for r in reports["load_summary"].collect()}
    assert outcomes["total"] == sum(n for o, n in outcomes.items() if o != "total") > outcomes["loaded"] > 0
    assert reports["ratings_by_source"].count() == 2
    assert reports["missing_files"].count() > 10
    write_reports(reports, f"{paths['base']}/reports")
    for name, report in reports.items():
        assert spark.read.parquet(f"{paths['base']}/reports/{name}").count() == report.count()


def test_train_evaluate_score(spark, paths):
    args = (spark, paths["metadata"], paths["packed"], paths["model"], paths["manifest"])
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    result, reports = run_training(*args, config=SMALL_CONFIG, exact_split=True)
    assert not [p for p in set(shared.iterdir()) - before if p.name.startswith("run-")]
    assert result.predictions.count() == 4 * reports["split"].where("split = 'test'").first().n_rows
    split = {r.split: r.n_rows for r in reports["split"].collect()}
    total = sum(split.values())
    assert abs(split["test"] - -(-total * 3 // 10)) <= 1
    assert reports["mae_by_range"].count() > 0 and reports["sample_predictions"].count() == min(15, split["test"])

    evaluation = run_evaluation(*args)
    assert evaluation["metrics"].first().n_rows == split["test"]
    files = evaluation["files"].first()
    assert files.n_documents == files.n_existing == split["test"] and evaluation["skipped"].count() == 0

    scored = run_scoring(spark, paths["folder"], paths["model"], f"{paths['base']}/scored")
    assert scored.count() == open_corpus(spark, paths["folder"]).count()

    streamed = run_stream(spark, paths["folder"], paths["model"], f"{paths['base']}/streamed", f"{paths['base']}/streaming")
    assert streamed.count() == scored.count()
    packed = run_packing(spark, paths["folder"], f"{paths['base']}/packed.parquet", files=3).first()
    assert packed.n_files == scored.count()
    assert len(list(Path(f"{paths['base']}/packed.parquet").glob("*.parquet"))) == 3

    model = load_model(spark, paths["model"])
    name = scored.where("error is null").first().file_name
    one = S.predict_document(spark, f"{paths['folder']}/{name}", model, year=1999, movie_length=100.0).collect()
    assert [(r.file_name, r.year, r.decade_encoded, r.movie_length) for r in one] == [(name, 1999, 0, 100.0)]
    batch = S.batch_predict(spark, [f"{paths['folder']}/{name}"], model).first()
    assert batch.predicted_rating == scored.where(scored.file_name == name).first().predicted_rating
    assert result.best == model.name


def test_missing_inputs(spark, paths):
    with pytest.raises(FileNotFoundError):
        open_corpus(spark, f"{paths['base']}/nowhere")
    with pytest.raises(FileNotFoundError):
        run_evaluation(spark, paths["metadata"], paths["packed"], f"{paths['base']}/no-model", paths["manifest"])
