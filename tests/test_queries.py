"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from rosterline import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, name):
    same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
