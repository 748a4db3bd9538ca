"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import differences, duck

from weft import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert not differences(got, con.execute(registry.oracle_sql()[name]).fetchdf())
