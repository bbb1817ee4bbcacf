"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

from conftest import SF_SMALL
from millrun.plans.check import compare, duck
from millrun.plans.oracle import ORACLE
from millrun.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, con)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r
    assert r["types_match"], r
