"""Shares of lines and texts as SQL has them: lines without a character, and shares that lie between two rounded ones."""

import duckdb
import pytest

from quire.plans.oracle import ORACLE
from quire.plans.queries import QUERIES

TEXTS = [None, "", "\n", "a\n\nb", "\n\nx \n", "x y\n" + "\n" * 400, *[" " * k + "x" * (640 - k) for k in (637, 631, 627, 621, 617, 101)], *[" " * k + "x" * (160 - k) for k in (1, 3, 53, 101)]]


@pytest.mark.parametrize("name", ["row_profile", "mean_luminance"])
def test_shares_are_those_of_sql(spark, tmp_path, name):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(enumerate(TEXTS)))
    db.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    got = {tuple(r) for r in found.collect()}
    assert got == set(db.sql(f"select {', '.join(found.columns)} from ({ORACLE[name]}) z").fetchall())
