"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, queries()[name], oracle_sql()[name], SF) is None
