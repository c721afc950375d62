"""Every query of the library against its DuckDB twin, and the contract of the entry points."""

import pytest

import __spark_entry__
from prosewright.plans import catalog
from tests.twin import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_twin(spark, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert not differences(df, SF, sql)
    else:
        assert df.count() > 0


def test_entry_points():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
