"""Every registered query against its SQL in DuckDB, over the whole of the smallest tables; the rest must run."""

import datetime
import decimal
import glob
import math
import os

import pytest

DATA = os.environ.get("ATTESTRA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows(table, names):
    return sorted(zip(*([plain(x) for x in table.column(n).to_pylist()] for n in names))) if table.num_rows else []


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def test_all(spark, duck):
    from attestra import registry

    sql, wrong = registry.oracle_sql(), []
    for name, query in registry.queries().items():
        got = query(spark, DATA).toArrow()
        if name in sql:
            want = duck.execute(sql[name]).to_arrow_table()
            names = sorted(want.column_names)
            if sorted(got.column_names) != names or rows(got, names) != rows(want, names):
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_id", "cand", "hybrid", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
