"""Edits of page order with balancing and mirroring against a loop over lists, and the shuffles they take."""

import random
import re

import pytest

from quire.operators import arrange

PAGE = "documentid long, id long, sortorder int, pagetype string, spreadid long, spreadside string, pinside string, filler boolean, staged boolean, layoutside string"


def drawn(rng, document):
    """Pages of a document and its import area, as dicts in no order."""
    out, i, order = [], document * 1000, 0
    for staged in (False, True):
        n = rng.randrange(0, 9)
        k = 0
        while k < n:
            filler = rng.random() < 0.25
            pair = not filler and k + 1 < n and rng.random() < 0.3
            for side in ("left", "right") if pair else (None,):
                i, order, k = i + 1, order + rng.randrange(1, 3), k + 1
                first = i if side != "right" else i - 1
                kind = "canvas" if filler and rng.random() < 0.8 else "image"
                out.append({"documentid": document, "id": i, "sortorder": order, "pagetype": kind, "spreadid": first if pair else None, "spreadside": side, "pinside": None if pair or filler else rng.choice([None, None, "left", "right", "up"]), "filler": filler, "staged": staged, "layoutside": rng.choice([None, "left", "right"])})
    rng.shuffle(out)
    return out


def balance(pages, right, used):
    """(id, position, side, filler, spreadid, spreadside, turned) of pages in order, one after the other."""
    spare = [p for p in pages if p["filler"] and p["pagetype"] == "canvas" and p["id"] not in used]
    out, side = [], lambda: "right" if ((len(out) + 1) % 2 == 1) == right else "left"
    for p in pages:
        if p in spare:
            continue
        want = p["spreadside"] if p["spreadid"] and p["spreadside"] in ("left", "right") else p["pinside"] if p["pinside"] in ("left", "right") else None
        if want and side() != want:
            out.append((len(out), None))
        out.append((len(out), p))
    rows, blanks = [], iter(spare)
    for k, p in out:
        at = "right" if ((k + 1) % 2 == 1) == right else "left"
        if p is None:
            f = next(blanks, None)
            rows.append((f["id"] if f else None, k + 1, at, True, None, None, False))
        else:
            rows.append((p["id"], k + 1, at, p["filler"], p["spreadid"], p["spreadside"], p["layoutside"] is not None and p["layoutside"] != at))
    return rows


def in_order(pages, staged=False):
    return sorted((dict(p) for p in pages if p["staged"] == staged), key=lambda p: (p["sortorder"], p["id"]))


def adopted(pages, command, used):
    ids, anchor = command
    here, area = in_order(pages), in_order(pages, True)
    new = [p for p in area if p["id"] in ids]
    lost = {p["spreadid"] for p in new if p["spreadid"] and any(q["spreadid"] == p["spreadid"] and q["id"] not in ids for q in area)}
    for p in new:
        if p["spreadid"] in lost:
            p["spreadid"] = p["spreadside"] = None
    if anchor == 0:
        return new + here
    at = next((k + 1 for k, p in enumerate(here) if p["id"] == anchor), len(here))
    return here[:at] + new + here[at:]


def inserted(pages, command, used):
    which, before = command
    here = in_order(pages)
    at = next((k for k, p in enumerate(here) if p["id"] == which), None)
    if at is None:
        return here
    if here[at]["spreadid"]:
        at = next((k for k, p in enumerate(here) if p["spreadid"] == here[at]["spreadid"] and p["spreadside"] == ("left" if before else "right")), at)
    blank = {**dict.fromkeys(here[0]), "pagetype": "canvas", "filler": False}
    return here[:at] + [blank] + here[at:] if before else here[: at + 1] + [blank] + here[at + 1 :]


def moved(pages, command, used):
    which, up = command
    here = in_order(pages)
    spare = [p for p in here if p["filler"] and p["pagetype"] == "canvas" and p["id"] not in used]
    units: dict = {}
    for p in here:
        if p not in spare:
            units.setdefault(p["spreadid"] or -p["id"], []).append(p)
    keys = list(units)
    at = next((k for k, u in enumerate(keys) if any(p["id"] == which for p in units[u])), None)
    to = None if at is None else at - 1 if up else at + 1
    if to is not None and 0 <= to < len(keys):
        keys[at], keys[to] = keys[to], keys[at]
    return [p for k in keys for p in units[k]] + spare


def linked(pages, command, used):
    here = in_order(pages)
    plain = [p for p in here if not p["filler"]]
    for p, q in zip(plain, plain[1:]):
        if p["id"] == command[0] and not p["spreadid"] and not q["spreadid"]:
            p.update(spreadid=p["id"], spreadside="left", pinside=None)
            q.update(spreadid=p["id"], spreadside="right", pinside=None)
            break
    return here


KINDS = {"adopt": (adopted, arrange.adopt), "insert": (inserted, arrange.insert), "move": (moved, arrange.move), "link": (linked, arrange.link)}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("with_used", [False, True])
def test_edits_are_the_loop(spark, kind, with_used):
    rng, loop, operator = random.Random(len(kind) * 2 + with_used), *KINDS[kind]
    docs = {d: drawn(rng, d) for d in range(1, 250)}
    right = {d: rng.random() < 0.7 for d in docs}
    used = {p["id"] for ps in docs.values() for p in ps if rng.random() < 0.3} if with_used else set()
    commands, rows = {}, []
    for d, pages in docs.items():
        ids = [p["id"] for p in pages] + [7]
        if rng.random() < 0.1:
            commands[d] = ((), None) if kind == "adopt" else (None, None)
        elif kind == "adopt":
            chosen = {p["id"] for p in pages if p["staged"] and rng.random() < 0.6} | set(rng.sample(ids, 1))
            commands[d] = chosen, rng.choice([None, 0, *ids])
            rows += [(d, i, commands[d][1]) for i in chosen]
        else:
            commands[d] = rng.choice(ids), rng.random() < 0.5
            rows.append((d, *commands[d]))
    given = spark.createDataFrame(rows, "documentid long, id long, " + {"adopt": "anchor long", "insert": "before boolean", "move": "up boolean", "link": "spare boolean"}[kind])
    pages = spark.createDataFrame([tuple(p[c.split()[0]] for c in PAGE.split(", ")) for ps in docs.values() for p in ps], PAGE).repartition(5)
    documents = spark.createDataFrame(list(right.items()), "id long, firstpageright boolean")
    overlays = spark.createDataFrame([(i,) for i in used], "pageid long") if with_used else None
    got = {}
    for r in operator(pages, documents, given, overlays).collect():
        assert r.layoutside in (None, r.side)
        got.setdefault(r.documentid, []).append((r.id, r.position, r.side, r.filler, r.spreadid, r.spreadside, r.turned))
    for d, ps in docs.items():
        assert sorted(got.get(d, []), key=lambda r: r[1]) == balance(loop(ps, commands[d], used), right[d], used), (d, commands[d], ps)


@pytest.mark.parametrize("kind", KINDS)
def test_edits_take_three_shuffles(spark, kind):
    pages, documents = spark.createDataFrame([], PAGE), spark.createDataFrame([], "id long, firstpageright boolean")
    given = spark.createDataFrame([], "documentid long, id long, " + {"adopt": "anchor long", "insert": "before boolean", "move": "up boolean", "link": "spare boolean"}[kind])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rdd = lambda d: spark.createDataFrame(d.rdd, d.schema)
        plan = KINDS[kind][1](rdd(pages), rdd(documents), rdd(given))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"\bExchange\b", plan)) <= 3, plan


def test_new_ids_count_on(spark):
    rows = spark.createDataFrame([(d, k, None if k % 3 == 0 else d * 100 + k) for d in range(1, 40) for k in range(d % 7)], "documentid long, position int, id long").repartition(6)
    for buckets in (1, 5, 4096):
        got = arrange.numbered(rows, 10_000, "documentid", "position", where=rows.id.isNull(), buckets=buckets).collect()
        want = sorted((r.documentid % buckets, r.documentid, r.position) for r in rows.collect() if r.id is None)
        assert {(r.documentid, r.position): r.id for r in got if r.position % 3 == 0} == {w[1:]: 10_000 + i for i, w in enumerate(want)}
        assert all(r.id == r.documentid * 100 + r.position for r in got if r.position % 3)
