import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over one row of values."""
    def run(column, **values):
        from pyspark.sql import types as T
        kinds = {str: T.StringType(), int: T.LongType(), bool: T.BooleanType(), float: T.DoubleType(),
                 list: T.ArrayType(T.StringType()), type(None): T.StringType()}
        schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()])
        return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]
    return run
