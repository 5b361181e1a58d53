"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import pytest

from textloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in at] == cols
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
