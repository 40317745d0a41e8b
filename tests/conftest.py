import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small literal frames: ``frame("a string, b int", (..), (..))``."""

    def build(schema, *rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of the given columns, doubles rounded."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df

        def plain(value):
            return round(value, 9) if isinstance(value, float) else value

        found = [tuple(plain(v) for v in row) for row in picked.collect()]
        return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
