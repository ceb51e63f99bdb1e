import pytest

from vellum.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, same_as_sql):
    if name in SQL:
        same_as_sql(QUERIES[name], SQL[name], sf_dir)
    else:
        assert QUERIES[name](spark, str(sf_dir)).count() > 0
