"""Every registered query of the library against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from quire.plans.oracle import ORACLE
from quire.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE:
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = sorted((tuple(map(norm, r)) for r in db.sql(f"select {quoted} from ({ORACLE[name]}) z").fetchall()), key=repr)
        assert got == want
    else:
        assert got
