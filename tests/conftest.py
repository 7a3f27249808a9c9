import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footfall.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a frame as a sorted list of tuples."""
    def read(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, v) for v in t))
    return read


@pytest.fixture
def sightings(spark):
    """[(device, ap, rssi, ts), ..] -> sightings frame."""
    def make(data):
        return spark.createDataFrame([(i, *r[:2], float(r[2]), r[3]) for i, r in enumerate(data)],
                                     "seq BIGINT, device STRING, ap STRING, rssi DOUBLE, ts BIGINT")
    return make


@pytest.fixture
def dim(spark):
    from footfall.sources.dims import ap_dim
    return ap_dim(spark, [("O", 1, "outside"), ("I", 1, "inside"), ("P", 2, "outside"), ("J", 2, "inside")])
