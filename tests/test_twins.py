"""Every registered query against its DuckDB twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from abacist.plans import catalog
from compare import difference, duck

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, con, name):
    found = difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    if found == "no rows":  # the smallest tables have none: the next ones must
        found = difference(QUERIES[name](spark, LARGER), duck(LARGER), ORACLES[name])
    assert found == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert catalog.oracles().keys() == catalog.queries().keys()
