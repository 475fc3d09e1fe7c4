import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session, drop_layers  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_layers(session)
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def _no_layers_left(spark):
    yield
    drop_layers(spark)
    spark.catalog.clearCache()  # rows that tests of the module have cached
