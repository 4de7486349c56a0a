"""Copies and restores of whole documents: what comes out is what went in, under other ids."""

import random

from pyspark.sql import functions as F

from quire.operators import copies
from quire.operators import order as O

DOCUMENT, SOURCE = "id long, name string, firstpageright boolean, masterid long, masterrange string", "id long, documentid long, title string, flowmap map<bigint,array<int>>"
PAGE = "id long, documentid long, sourceid long, sortorder int, pagetype string, spreadid long, spreadside string, pinside string, filler boolean, staged boolean, layoutside string"
OVERLAY = "id long, pageid long, overlaytype string, x double, sortorder int"
FIRST = {"document": 10_000, "source": 20_000, "page": 30_000, "overlay": 40_000}


def drawn(rng):
    documents, sources, pages, overlays = [], [], [], []
    for d in range(1, 40):
        documents.append((d, f"n{d}", rng.random() < 0.5, rng.choice([None, rng.randrange(1, 60)]), "1-2"))
        mine = [d * 100 + k for k in range(rng.randrange(0, 4))]
        n = rng.randrange(0, 8)
        ids = [d * 1000 + k for k in range(n)]
        for s in mine:
            sources.append((s, d, f"s{s}", rng.choice([None, {i: [k, k + 1] for k, i in enumerate(rng.sample(ids, min(2, n)))} | {5: [1]}])))
        for k, i in enumerate(ids):
            pair = k + 1 < n and k % 2 == 0 and rng.random() < 0.5 or (pages and pages[-1][5] == i - 1 and pages[-1][6] == "left")
            half = "right" if pages and pages[-1][6] == "left" and pages[-1][5] == i - 1 else "left"
            pages.append((i, d, rng.choice([None, 99_999, *mine]), k + 1, "image", (i if half == "left" else i - 1) if pair else None, half if pair else None, None, False, rng.random() < 0.2, None))
            overlays += [(i * 10 + j, i, "mask", rng.random(), rng.randrange(3)) for j in range(rng.randrange(3))]
    return documents, sources, pages, overlays


def tables(spark, rows):
    return {n: spark.createDataFrame(r, s).repartition(3) for n, r, s in zip(FIRST, rows, (DOCUMENT, SOURCE, PAGE, OVERLAY))}


def shape(t):
    """All tables with names of rows in place of ids: documents by name, pages and overlays by their place."""
    rows = {n: [r.asDict() for r in d.collect()] for n, d in t.items()}
    doc = {r["id"]: r["name"] for r in rows["document"]}
    source = {r["id"]: (doc[r["documentid"]], r["title"]) for r in rows["source"]}
    page = {r["id"]: (doc[r["documentid"]], r["sortorder"]) for r in rows["page"]}
    out = [("document", r["name"], r["firstpageright"]) for r in rows["document"]]
    out += [("source", source[r["id"]], None if r["flowmap"] is None else sorted((page[k], v) for k, v in r["flowmap"].items() if k in page)) for r in rows["source"]]
    out += [("page", page[r["id"]], source.get(r["sourceid"]), page.get(r["spreadid"]), r["spreadside"], r["staged"]) for r in rows["page"]]
    out += [("overlay", page[r["pageid"]], r["x"], r["sortorder"]) for r in rows["overlay"]]
    return sorted(out, key=repr)


def test_what_is_restored_is_what_was_exported(spark):
    before = tables(spark, drawn(random.Random(6)))
    nested = copies.export_whole(*before.values())
    again = copies.tables_of(nested)
    assert shape(again) == shape(before)
    for r in nested.collect():
        assert [s.id for s in r.sources] == sorted(s.id for s in r.sources) and [(p.sortorder, p.id) for p in r.pages] == sorted((p.sortorder, p.id) for p in r.pages)
        assert all([(o.sortorder, o.id) for o in p.overlays] == sorted((o.sortorder, o.id) for o in p.overlays) for p in r.pages)
    known = before["document"].where("id < 20").select("id")
    after = copies.restored(again, FIRST, known)
    assert shape(after) == shape(before)
    for name, first in FIRST.items():
        ids = sorted(r.id for r in after[name].collect())
        assert ids == list(range(first, first + len(ids)))
    here = {r.id for r in known.collect()}
    lineage = {r.name: (r.masterid, r.masterrange) for r in after["document"].collect()}
    assert all(lineage[r.name] == ((r.masterid, r.masterrange) if r.masterid in here else (None, None)) for r in before["document"].collect())
    empty = {n: d.limit(0) for n, d in before.items()}
    assert all(d.count() == 0 for d in copies.restored(empty, FIRST).values())


def test_copies_bring_everything_along(spark):
    t = tables(spark, drawn(random.Random(9)))
    rows = {n: [r.asDict() for r in d.collect()] for n, d in t.items()}
    commands = [(d, d % 7 + 20, rng) for d, rng in zip(range(1, 15), ["", "1-", "2-3", "9", "1,3", "3-", "2"] * 2)]
    made = copies.copied(t, spark.createDataFrame(commands, "target long, masterid long, range string"), FIRST)
    got = {n: [r.asDict() for r in d.collect()] for n, d in made.items()}
    pages = {p["id"]: p for p in rows["page"]}
    source_of = {(s["documentid"], s["id"]): s for s in got["source"]}
    have = {s["id"] for s in rows["source"]}
    for target, master, rng in commands:
        own = sorted((p for p in rows["page"] if p["documentid"] == master and not p["staged"]), key=lambda p: p["sortorder"])
        want = {"": range(1, 99), "1-": range(1, 99), "2-3": (2, 3), "9": (9,), "1,3": (1, 3), "3-": range(3, 99), "2": (2,)}[rng]
        chosen = [p for k, p in enumerate(own) if k + 1 in want]
        mine = sorted((p for p in got["page"] if p["documentid"] == target), key=lambda p: p["sortorder"])
        assert [p["copied_from"] for p in mine] == [p["id"] for p in chosen]
        top = max([p["sortorder"] for p in rows["page"] if p["documentid"] == target], default=0)
        assert [p["sortorder"] for p in mine] == [top + k + 1 for k in range(len(mine))]
        new = {p["copied_from"]: p["id"] for p in mine}
        for p in mine:
            old = pages[p["copied_from"]]
            partner = [q["id"] for q in chosen if old["spreadid"] and q["spreadid"] == old["spreadid"]]
            assert p["spreadid"] == (new[partner[0]] if len(partner) == 2 else None) and p["spreadside"] == (old["spreadside"] if len(partner) == 2 else None)
            assert (p["sourceid"] is None) == (old["sourceid"] not in have)
            if p["sourceid"]:
                assert source_of[target, p["sourceid"]]["copied_from"] == old["sourceid"]
            assert sorted(o["x"] for o in got["overlay"] if o["pageid"] == p["id"]) == sorted(o["x"] for o in rows["overlay"] if o["pageid"] == old["id"])
        assert sum(s["documentid"] == target for s in got["source"]) == len({p["sourceid"] for p in chosen} & have)
    assert {d["id"]: (d["masterid"], d["masterrange"]) for d in got["document"]} == {t: (m, r) for t, m, r in commands}
    for n in ("source", "page", "overlay"):
        assert sorted(r["id"] for r in got[n]) == list(range(FIRST[n], FIRST[n] + len(got[n])))
    settled = copies.with_copies(t, made).collect()
    assert {r.id for r in settled if r.id} == {p["id"] for p in got["page"]} | {p["id"] for p in rows["page"] if p["documentid"] <= 14 and not p["staged"]}


def test_deletions_leave_nothing_behind(spark):
    t = tables(spark, drawn(random.Random(2)))
    t["job"] = spark.createDataFrame([(k, k % 50) for k in range(200)], "id long, documentid long")
    gone = {3, 7, 11, 20}
    left = copies.deleted(t, spark.createDataFrame([(i,) for i in (*gone, 3)], "id long"))
    ids = {r.id for r in left["document"].collect()}
    assert ids == {r.id for r in t["document"].collect()} - gone and not {r.masterid for r in left["document"].collect()} & gone
    for n in ("source", "page", "job"):
        assert {r.id for r in left[n].collect()} == {r.id for r in t[n].collect() if r.documentid not in gone}
    pages = {r.id for r in left["page"].collect()}
    assert {r.id for r in left["overlay"].collect()} == {r.id for r in t["overlay"].collect() if r.pageid in pages}


def test_null_keys_are_dealt_out(spark):
    """Rows in no spread, or without a master, aren't one task's: no partition behind the lookup holds most of them."""
    from quire.functions.keys import looked_up

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id END AS spreadid", "'left' AS spreadside")
        left = O.unlink(rows, rows.where("id % 20 = 0").select("spreadid"))
        sizes = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000
        assert left.where("spreadid IS NOT NULL").count() == 200
        found = looked_up(rows, "spreadid", spark.createDataFrame([(0, "a"), (10, "b"), (None, "c")], "spreadid long, x string"))
        assert sorted((r.id, r.x) for r in found.where("x IS NOT NULL").collect()) == [(0, "a"), (10, "b")] and found.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_masters_of_one_user_are_many_tasks(spark):
    """All documents of one user: each meets each master but itself, and no task makes most of the rows."""
    from quire.operators import provenance

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = spark.range(600).selectExpr("id", "1 AS course", "id % 2 = 0 AS ismaster")
        grants = spark.createDataFrame([(5, 1), (5, 1), (6, 2)], "userid int, course int")
        found = provenance.copy_sources(documents, grants, documents.selectExpr("5 AS userid", "id AS documentid").where("documentid < 40"))
        assert sorted(map(tuple, found.collect())) == [(5, i, j) for i in range(40) for j in range(0, 600, 2) if i != j]
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < found.count() / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
