import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import local_session

    session = local_session(8, "vigil-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Small tables as literals."""
    from vigil.session import literal_rows

    def make(rows, schema):
        return literal_rows(spark, rows, schema)

    return make


@pytest.fixture(scope="session")
def apply(table):
    """Run a column function over a list of strings and return the values in order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = table([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[1] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
