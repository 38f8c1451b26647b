"""Every registered query outside `kindred.llm` against its SQL."""

import pytest
from oracle import compare

from kindred.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    compare(spark, folder, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "target", "weight", "type"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
