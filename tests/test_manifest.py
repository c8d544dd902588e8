"""The manifest of a load that was not trained on."""

from scriptorium.catalog.training_runs import manifest, training


def test_manifest_needs_no_training(spark, sf_dir):
    alone = manifest(spark, sf_dir)
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "AS clean" not in plan  # no text is cleaned or measured for it
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, training(spark, sf_dir).manifest.collect()))
