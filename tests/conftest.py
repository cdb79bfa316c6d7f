import pytest
from pyspark.sql import SparkSession

from veilspark.plans import storage


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("veilspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling costs more
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Force every distributed plan: nothing is small, and a few rows make a key heavy."""
    for name, value in {
        "broadcast_rows": 0, "window_rows": 0, "heavy_rows": 3, "heavy_keys": 1000, "pattern_terms": 0,
    }.items():
        monkeypatch.setattr(storage.LIMITS, name, value)
