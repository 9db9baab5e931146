import pytest
from compare import spark_rows, sql_rows

from nymora.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    assert spark_rows(queries.queries()[name](spark, tables)) == sql_rows(tables, queries.oracle_sql()[name])


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
