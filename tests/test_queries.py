"""Every registered query against its SQL on the smallest test tables."""

import math

import pytest

import __spark_entry__ as entry
from tests.check_queries import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def key(row):
    return tuple(f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-4)  # a rounding tie may fall either way
    return a == b


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
