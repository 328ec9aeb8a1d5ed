import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """(id, agg, features) from a list of vectors; ids count from 1."""

    def make(vectors, ids=None):
        ids = [int(i) for i in ids or range(1, len(vectors) + 1)]
        columns = {
            "id": pa.array(ids, pa.int64()),
            "agg": pa.array([float(i) for i in ids]),
            "features": pa.array([[float(x) for x in v] for v in vectors]),
        }
        return spark.createDataFrame(pa.table(columns))

    return make
