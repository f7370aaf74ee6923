"""Every registered domain query against its SQL."""

import pytest
from compare import differences

from tickerloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), ORACLE_SQL[name], con) == ""


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "user_id"
