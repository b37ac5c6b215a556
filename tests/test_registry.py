"""Every registered query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from veristrata.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.Q))
def test_query(spark, duck, name):
    got = registry.Q[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(tuple(same(r[c]) for c in names) for r in got.collect())
    if name in registry.SQL:
        wanted = duck.execute(registry.SQL[name])
        columns = [d[0] for d in wanted.description]
        assert sorted(columns) == names
        assert sorted(tuple(same(dict(zip(columns, r, strict=True))[c]) for c in names) for r in wanted.fetchall()) == rows
    else:
        assert rows
