from __future__ import annotations

import pytest
from pyspark.sql import SparkSession, functions as F


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("evalweave-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of single values, in order."""

    def evaluate(function, items, schema="string"):
        rows = [(i, item) for i, item in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, x {schema}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("x")).alias("y")).collect()]

    return evaluate
