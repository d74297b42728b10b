"""Every query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sparsecg.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


def test_all_have_sql_and_are_registered():
    assert set(ORACLE_SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
