"""Every registered query of the retrieval engine against its SQL."""

from __future__ import annotations

import pytest

from quire.plans import catalog

from .oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    frame = catalog.QUERIES[name](spark, sf)
    if name in catalog.SQL:
        assert compare(spark, duck, frame, catalog.SQL[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
