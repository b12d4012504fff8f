import uuid

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame of literal rows with a DDL schema."""
    def make(values, schema, partitions=None):
        df = spark.createDataFrame(values, T.StructType.fromDDL(schema))
        return df.repartition(partitions) if partitions else df

    return make


@pytest.fixture()
def ws(spark):
    from vigil.llm.shared import Workspace

    space = Workspace(spark, f"test-{uuid.uuid4().hex}")
    yield space
    space.drop()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, label int, codes string"


@pytest.fixture(scope="session")
def awkward(rows):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, ties, and columns with clashing names."""
    long_text = " ".join(f"word{i % 997} Tail" for i in range(60_000))
    values = [(1, None, None, None, None, None, None, None, None), (None, "alone without an id", "en", "a", 1, "k", 0.5, 1, "c"),
              (2, "", "en", "a", 0, "k", 0.5, 1, "c"), (3, "!!! ... \n\t", "en", "a", 9, "k", 0.5, 1, "c"),
              (4, long_text, "en", "b", len(long_text), "k", 0.5, 1, "c"), (5, "Same TEXT é É", "fr", "b", 13, "k", None, 0, "c"),
              (6, "same text é É", "fr", None, 13, "k", 0.1, 0, "c"), (6, "same text é É", "fr", None, 13, "k", 0.1, 0, "c"),
              (7, "same text é é", "fr", None, 13, "k", 0.1, 0, "c")]
    return rows(values, DOCS)


@pytest.fixture(scope="session")
def no_docs(rows):
    return rows([], DOCS)
