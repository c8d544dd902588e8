import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.session import build_session  # noqa: E402

from scriptorium.catalog import training_runs  # noqa: E402
from scriptorium.plans.models import ModelConfig  # noqa: E402

# Same models, smaller ensembles and earlier stops.
SMALL_CONFIG = ModelConfig(forest_trees=20, forest_depth=5, boosting_stages=10, boosting_depth=3, linear_iterations=100)
training_runs.CONFIG = SMALL_CONFIG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
