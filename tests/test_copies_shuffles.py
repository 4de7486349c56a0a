"""What exports, restores and lookups shuffle: pages stay with their document, salts are small, keys that are odd lose nothing."""

import re

import pytest

from quire.functions.keys import looked_up
from quire.operators import copies


@pytest.fixture
def session(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return s


def _tables(s):
    documents = s.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    sources = s.createDataFrame([(7, 1), (8, 2)], "id long, documentid long")
    pages = s.createDataFrame([(10, 1, 2, "x"), (11, 1, 1, "y"), (20, 2, 1, None), (20, 2, 1, None), (None, 2, 3, "n"), (None, 2, 2, "m"), (40, None, 1, "lost"), (50, 9, 1, "lost")], "id long, documentid long, sortorder int, name string")
    overlays = s.createDataFrame([(1, 10, 2), (2, 10, 1), (3, 20, 1), (4, None, 1), (5, 99, 1), (6, 40, 1)], "id long, pageid long, sortorder int")
    return documents, sources, pages, overlays


def test_odd_keys_are_exported_as_they_are(session):
    found = {r.id: r for r in copies.export_whole(*_tables(session)).collect()}
    pages = {i: [(p.documentid, p.id, p.name, [(o.id, o.pageid) for o in p.overlays]) for p in found[i].pages] for i in found}
    assert pages == {1: [(1, 11, "y", []), (1, 10, "x", [(2, 10), (1, 10)])], 2: [(2, 20, None, [(3, 20)])] * 2 + [(2, None, "m", []), (2, None, "n", [])], 3: []}
    assert [[(s.id, s.documentid) for s in found[i].sources] for i in (1, 2, 3)] == [[(7, 1)], [(8, 2)], []]


def test_pages_of_a_document_are_not_shuffled_again(session):
    documents, sources, pages, overlays = _tables(session)
    nested = copies.export_whole(documents, sources, pages.repartition("documentid"), overlays)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Union")[0].count("Exchange") == 2  # of documents and of sources


def test_salts_are_small(session):
    rows = session.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN id END AS spreadid")
    found = looked_up(rows, "spreadid", rows.where("spreadid IS NOT NULL").selectExpr("spreadid", "id AS x"))
    salts = re.findall(r"xxhash64\([^)]*\)", found._jdf.queryExecution().executedPlan().toString())
    assert salts and found.where("x = spreadid").count() == 6667 and found.count() == 20000
    assert "pmod(xxhash64(" in found._jdf.queryExecution().executedPlan().toString()
