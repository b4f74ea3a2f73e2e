import pytest

from loomline.plans import exchange, raw_input, reference
from oracle import check

SQL = raw_input.ORACLE_SQL | reference.ORACLE_SQL | exchange.ORACLE_SQL
QUERIES = raw_input.QUERIES | reference.QUERIES | exchange.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        QUERIES[name](spark, sf).limit(5).collect()
