from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postweir.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", conf={
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
    })
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Apply a text column function to a list of strings."""
    from pyspark.sql import functions as F

    def apply(function, values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, t string").repartition(4)
        return [r["o"] for r in df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()]

    return apply
