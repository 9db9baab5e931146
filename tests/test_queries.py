import pytest
from compare import spark_rows, sql_rows

from nymora.plans import queries as plans


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, tables, name):
    got = spark_rows(plans.queries()[name](spark, tables))
    sql = plans.oracle_sql().get(name)
    if sql:
        assert got == sql_rows(tables, sql)
    else:
        assert got[1]


def test_every_sql_has_its_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "masked", "n_entities"]
