import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A table out of rows and a schema, or of one list per column."""

    def make(schema, rows=None, **columns):
        rows = list(zip(*columns.values())) if rows is None else rows
        return spark.createDataFrame(rows, schema)

    return make


def dicts(df, *keys):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: [r[k] for k in keys]) if keys else rows


def column(df, name="column"):
    return [r[name] for r in df.collect()]
