"""Every query with a SQL twin gives the twin's rows on the small tables."""

import pytest
from oracle_check import compare

from terrapath.plans import catalog


#: Queries that rightly find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, con, sf, name):
    status, rows, _, _, info = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert status == "ok" or (status == "EMPTY" and name in MAY_BE_EMPTY), info or status


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
