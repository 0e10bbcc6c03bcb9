"""Every query that has SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

KEYS = sorted(k for k in E.oracle_sql() if not (k.startswith("op") or k == "pipeline"))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, sf_dir, key):
    got = E.queries()[key](spark, sf_dir)
    want = duck.execute(E.oracle_sql()[key])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda data: sorted((tuple(plain(v) for v in r) for r in data), key=repr)
    a, b = rows(got.select(*names).collect()), rows(want.fetchall())
    assert len(a) == len(b) and len(a) > 0
    bad = [(x, y) for x, y in zip(a, b, strict=True) if any(abs(p - q) > 2e-6 * max(1, abs(q)) if isinstance(p, float) and isinstance(q, float | int) else p != q for p, q in zip(x, y, strict=True))]
    assert not bad[:3]
