"""Every query against its SQL twin; queries without one must run and be non-empty where they should be."""

import pytest

from attesta.plans import catalog
from tests.conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, duck, name):
    ours, twin = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns)
    assert rows_of(ours) == rows_of(twin)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
