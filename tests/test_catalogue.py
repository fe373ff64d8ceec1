import pytest
from oracle import spark_rows, sql_rows

import textloom.plans  # noqa: F401
from textloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == sql_rows(catalogue.ORACLES[name], SF)


def test_entry_summarises(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
