"""Every query of the network engine against its DuckDB twin."""

import pytest

from roadweave.plans import registry
from tests.oracle import connect, rows_of, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches(spark, duck, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == rows_of(duck, registry.ORACLES[name])
