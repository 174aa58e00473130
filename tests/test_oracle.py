"""Every query with SQL against DuckDB on the same tables, rows in any order."""

import math

import duckdb
import pytest

from larderlake import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y))
    return x == y and isinstance(x, bool) == isinstance(y, bool)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(got, want):
    return len(got) == len(want) and all(len(a) == len(b) and all(map(same, a, b)) for a, b in zip(got, want))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, small, name):
    df = Q.QUERIES[name](spark, small)
    want = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, map(tuple, df.collect())), rows(names, want.fetchall())
    assert compare(got, want), (got[:3], want[:3])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_without_sql(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_comparison_sees_a_wrong_row():
    a = rows(["x", "y"], [(1, "a"), (2, "b")])
    assert compare(a, rows(["y", "x"], [("b", 2), ("a", 1)])) and not compare(a, rows(["x", "y"], [(1, "a"), (2, "c")])) and not compare(a, a[:1])
