"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from colloquy.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    if name not in ORACLES:
        assert df.count() > 0
        return
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=str)
    assert got == want
