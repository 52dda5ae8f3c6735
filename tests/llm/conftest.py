import os
import sys

import pytest
from samples import AWKWARD

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the names that results have."""
    rows = [(i, t, "en", "s", 1, 0.5, "x", False) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, kept boolean")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")
