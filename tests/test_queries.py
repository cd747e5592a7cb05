"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math

import pytest
from conftest import SMALL

from lumastack.plans import registered

QUERIES, SQL = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    if name not in SQL:
        assert got.count() > 0
        return
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is not None, round(v, 4) if isinstance(v, float) else v) for v in r)
    a, b = sorted(map(tuple, got.select(*want.columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    assert all(_same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
