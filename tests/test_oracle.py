import math
import os

import duckdb
import pytest

from cinderfold import plans

REGISTRY = plans.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    return f"{float(v):.9g}" if not (isinstance(v, float) and math.isnan(v)) else "nan"


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in REGISTRY.ORACLE_SQL:
        out = duck.execute(REGISTRY.ORACLE_SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in out.fetchall())
    else:
        assert got
