from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from repolumen.session import drop_scratch, get_spark

    session = get_spark("tests", 8, **{
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # several blocks also for small inputs
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def files(spark):
    """Build a file table from ``{path: text}`` of one repository."""
    def build(texts: dict[str, str], repo: str = "r"):
        return spark.createDataFrame([(repo, p, t) for p, t in texts.items()],
                                     "repo string, file_path string, content string")
    return build
