"""Every registered query with SQL against DuckDB on the smallest tables."""

import collections
import math
import os

import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return bytes(x).hex() if isinstance(x, bytes | bytearray) else str(x)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name in plans.SQL:
        r = duck.execute(plans.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == collections.Counter(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
