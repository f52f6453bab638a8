"""Every registered query gives the rows of its comparison SQL on the smallest tables."""

import pytest
from compare import compare, entry

from newsflow.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, name):
    rows, problem = compare(spark, sf, name)
    assert not problem and rows >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)
