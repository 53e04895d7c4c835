"""Every training-data query with SQL against it, on the smallest tables."""

import pytest
from compare import DATA, database, rows

from mnemara import llm


@pytest.fixture(scope="module")
def con():
    return database("sf0.001")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = llm.queries()[name](spark, f"{DATA}/sf0.001").toPandas(), con.execute(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
