"""Every registered query of the core library against its SQL, on the smallest tables."""

import pytest

from canopy import registry
from oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, SF))
    assert names
    if name in registry.ORACLE_SQL:
        assert (names, rows) == sql_rows(registry.ORACLE_SQL[name], SF)
