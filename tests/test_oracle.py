"""Every query with SQL gives the same rows and column names as DuckDB."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from brightloom import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_as_duckdb(spark, db, name):
    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got.total() > 0 or name == "embeddings_missing"  # here every document has a vector
    if sql := plans.ORACLE_SQL.get(name):
        rel = db.sql(sql)
        assert sorted(rel.columns) == cols
        want = Counter(tuple(map(plain, r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())
        assert got == want, ((got - want).most_common(3), (want - got).most_common(3))
