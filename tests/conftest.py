import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF = os.environ.get("MERCHANTRY_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from merchantry.session import local_session
    s = local_session(extra={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def one_col(spark, values, fn, name="x"):
    """Apply a Column function to a one-column DataFrame of strings; return the list."""
    from pyspark.sql import types as T
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                               T.StructType([T.StructField("i", T.IntegerType()),
                                             T.StructField(name, T.StringType())]))
    return [r["y"] for r in df.select("i", fn(name).alias("y")).orderBy("i").collect()]
