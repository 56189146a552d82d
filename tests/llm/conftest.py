import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from transitloom.session import local_session  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 9000}" for i in range(20000))
    rows = [(1, "a b c " * 30, "en", "x", 5), (1, "a b c " * 30, "en", "x", 5), (2, None, None, None, None), (None, "", "en", "x", 0),
            (None, None, None, None, None), (3, long, "en", "y", 9), (4, long + " end", "en", None, 9), (5, " \t\n", "de", "y", 3)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS hits", "4 AS class_id", "5 AS row", "6 AS size", "7 AS fp")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
