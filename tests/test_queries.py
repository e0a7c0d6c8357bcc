"""Every query with an oracle equals it over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_oracle(spark, con, sf, name):
    difference, _ = compare(spark, con, name, sf)
    assert difference is None, difference


def test_registered():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100
