"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from skylattice.plans import catalog

from .compare import SMALL, connect, rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
