import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import CLASHES, COLUMNS, ROWS  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame([(*r, *["x"] * 8) for r in ROWS], f"{COLUMNS}, {CLASHES}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHES}")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 13)] + [(None, 1, 1), (6, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_marks(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
