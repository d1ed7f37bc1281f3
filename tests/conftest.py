import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stowage.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="stowage-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Builds a DataFrame from rows and a layout."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


@pytest.fixture()
def evaluate(spark):
    """Values of an expression over a column of inputs, in input order."""

    def run(values, ddl, make):
        from pyspark.sql import functions as F

        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {ddl}")
        out = df.select("i", make(F).alias("r")).orderBy("i").collect()
        return [row["r"] for row in out]

    return run
