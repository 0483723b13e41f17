"""Every registered query of the engine against its oracle SQL, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from corpusgraph.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert cols
        return
    res = duck.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, row))[c]) for c in cols]) for row in res.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
