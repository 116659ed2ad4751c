"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from larder.plans.all_queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(r[i]) for i in order) for r in told.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want
