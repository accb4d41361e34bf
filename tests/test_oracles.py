"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


KINDS = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got, columns = df.collect(), sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert columns == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for c, kind in df.dtypes:
        if kind in KINDS:
            assert KINDS[kind] == kinds[c], (c, kind, kinds[c])
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert len(got) == len(want)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got) == want
