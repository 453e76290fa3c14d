"""Every query of the library against its SQL twin on the smallest tables."""

import pytest

from tests.compare import difference
from waymark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(catalog.queries()[name](spark, FOLDER), ORACLES[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
