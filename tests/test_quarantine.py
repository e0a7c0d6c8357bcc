"""A masked value that equals text which stays: the chart is quarantined, and its cases go no further."""

import os

import duckdb
import pytest

from compare import compare, connect

FROM = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def echoing(sf, tmp_path_factory):
    """Charts 1 and 12630, whose ZIP is its procedure code 22630."""
    place = tmp_path_factory.mktemp("echo")
    for name in os.listdir(sf):
        if name not in ("customer.parquet", "orders.parquet"):
            os.symlink(f"{sf}/{name}", place / name)
    duckdb.sql(f"COPY (SELECT * FROM '{FROM}/customer.parquet' WHERE c_custkey IN (1, 12630)) TO '{place}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 12630 END AS o_custkey) FROM '{sf}/orders.parquet' WHERE o_orderkey < 40) TO '{place}/orders.parquet'")
    return str(place)


@pytest.mark.parametrize("name", ["chart_quarantine", "redacted_authorizations"])
def test_echo_is_quarantined(spark, echoing, name):
    difference, rows = compare(spark, connect(echoing), name, echoing)
    assert difference is None, difference
    assert rows > 0
