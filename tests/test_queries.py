import pytest

from vellum.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    if name in SQL:
        same_as_sql(QUERIES[name], SQL[name], sf_dir)
    else:
        assert QUERIES[name](spark, str(sf_dir)).count() > 0


def test_names_and_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
