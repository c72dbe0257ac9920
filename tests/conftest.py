import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tests-"))
    yield session
    session.stop()


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


NUMERIC = "Id long, Response byte, L0_S0_F0 double, L0_S0_F2 double, L1_S24_F1 double"
DATE = "Id long, L0_S0_D1 double, L0_S0_D3 double, L1_S24_D2 double"
CATEGORICAL = "Id long, L0_S0_F4 string, L1_S24_F5 string"


@pytest.fixture(scope="session")
def tables(spark):
    """Four parts: all three readings, one reading of the first station, the second station only, nothing."""
    numeric = spark.createDataFrame([(1, 1, 4.0, 1.25, -7.0), (2, 0, None, 2.5, None), (3, 0, None, None, 6.5), (4, 1, None, None, None)], NUMERIC)
    dates = spark.createDataFrame([(1, 3.0, 8.0, 5.5), (2, 7.25, None, None), (3, None, None, 9.0), (4, None, None, None)], DATE)
    categorical = spark.createDataFrame([(1, "T40", None), (2, "T7", "T2"), (3, None, "T2"), (4, None, None)], CATEGORICAL)
    return {"numeric": numeric, "date": dates, "categorical": categorical}
