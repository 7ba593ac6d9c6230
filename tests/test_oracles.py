"""Every registered query against its DuckDB oracle; those without one must run and keep their schema."""

import pytest
from oracle import connect, differences

from speechprep.plans import registry

CON = {}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        CON.setdefault(sf, connect(sf))
        assert differences(df, CON[sf], registry.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
