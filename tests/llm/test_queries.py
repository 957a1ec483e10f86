"""The registered queries against their SQL in DuckDB, over the whole of the smallest tables."""

import pytest

from attestra.llm import queries
from tests.test_queries import DATA, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.queries()[name](spark, DATA).toArrow()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns
        return
    want = duck.execute(sql).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names and rows(got, names) == rows(want, names)
