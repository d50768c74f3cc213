"""Every registered query against its SQL on the smallest tables; those without SQL against plain Python."""

import math
import os

import duckdb
import pytest

from seekmill.plans import registry

from brute import CHECKS

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, rows = sorted(df.columns), df.collect()
    if name not in SQL:
        CHECKS[name](rows, lambda columns, source: duck.execute(f"SELECT {columns} FROM {source}").fetchall())
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted("|".join(plain(r[c]) for c in columns) for r in rows) == want
