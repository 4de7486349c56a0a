"""What is read or made in Python is made once for each query."""

from __future__ import annotations

from quire.operators import impose, notes, typeset
from quire.sources import word


def _plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def test_pictures_of_word_files_open_an_archive_once(spark):
    rows = [("a", "relation", "r1", "word/media/x.png", None), ("a", "relation", "r2", "word/media/x.png", None), ("a", "relation", "r3", "word/media/none.png", None), ("a", "media", "media", "word/media/x.png", b"A"), ("a", "media", "media", "word/media/alone.png", b"B"), (None, "relation", "r1", "word/media/x.png", None), (None, "media", "media", "word/media/x.png", b"C")]
    parts = spark.createDataFrame(rows, "path string, part string, kind string, value string, data binary")
    assert sorted((r.path, r.id, r.filename, bytes(r.data)) for r in word.word_media(parts).collect()) == [("a", "r1", "x.png", b"A"), ("a", "r2", "x.png", b"A")]
    files = spark.createDataFrame([("a", b"no archive")], "path string, content binary")
    assert _plan(word.word_media(word.word_parts(files))).count("MapInArrow") == 1


def test_frames_set_the_pages_once(spark):
    rows = [("text", 1, 0, 0, 0.1, 0.1, 0.5, 0.1, "b"), ("text", 1, 0, 1, 0.1, 0.2, 0.5, 0.1, "c"), ("image", 1, 1, 0, 0.2, 0.3, 0.4, 0.2, None), ("image", 1, 1, 1, 0.2, 0.3, 0.4, 0.2, None), (None, 1, 2, 0, 0.2, 0.3, 0.4, 0.2, "x"), ("note", None, 3, 0, 0.7, 0.3, 0.2, 0.2, "n"), ("text", None, 4, 0, 0.1, 0.6, 0.5, 0.1, "t")]
    placed = spark.createDataFrame([(7, 1, "left", *r) for r in rows], "doc_id long, page_no int, side string, kind string, run int, block_index long, part int, x double, y double, w double, h double, html string")
    got = sorted((r.kind, r.block_index, r.html) for r in typeset.frames(placed).collect())
    assert got == [("image", 1, None), ("image", 1, None), ("note", 3, "n"), ("text", 0, "b\nc"), ("text", 4, "t")]
    blocks = spark.createDataFrame([(1, 0, "text", "p", "<p>a</p>")], "doc_id long, block_index long, kind string, tag string, html string")
    assert _plan(typeset.frames(typeset.typeset(blocks))).count("MapInArrow") == 1


def test_notes_are_cut_out_of_a_page_once(spark):
    pages = spark.createDataFrame([(1, "<p>a<aside>m</aside></p><p>b<span class='sidenote'>s</span></p><div class='marginnote'>e</div>"), (2, "<p>none</p>"), (3, None)], "id long, html string")
    found = notes.noted_blocks(pages, "id")
    assert _plan(found).count("ArrowEvalPython") == 1
    got = {(r.id, r.block_index): (r.kind, r.html, r.notes) for r in found.collect()}
    assert got == {(1, 0): ("text", "<p>a</p>", ["<p>m</p>"]), (1, 1): ("text", "<p>b<sup>1</sup></p>", ["<p><sup>1</sup> s</p>", "<p>e</p>"]), (2, 0): ("text", "<p>none</p>", [])}


def test_print_items_places_the_pages_once(spark):
    pages = spark.createDataFrame([(1, 10, 1, 7, 1240, 1754, False), (1, 11, 2, 8, 1240, 1754, False), (1, 12, 3, None, 1240, 1754, False), (1, 13, 4, 7, 1240, 1754, True)], "documentid long, id long, sortorder long, sourceid long, width int, height int, staged boolean")
    documents = spark.createDataFrame([(1, "", True)], "id long, pagerange string, firstpageright boolean")
    sources = spark.createDataFrame([(7, "T", "", "A", True), (8, "U", "", "", True)], "id long, title string, url string, author string, showcitation boolean")
    rows = [(3, 10, "textbox", 1), (2, 10, "mask", 1), (1, 10, "imageframe", 9), (4, 10, "audio", 1), (5, 11, "audio", 1), (6, 12, "mask", 1), (7, 13, "mask", 1), (8, None, "textbox", 1)]
    overlays = spark.createDataFrame([(*r, 0.1, 0.1, 0.5, 0.1) for r in rows], "id long, pageid long, overlaytype string, sortorder long, x double, y double, w double, h double")
    found = impose.print_items(pages, documents, overlays, sources)
    assert _plan(found).count("LocalTableScan") + _plan(found).count("ExistingRDD") == 4  # one for each input
    got = sorted((r.pageid, r.z, r.kind, r.overlayid, r.text) for r in found.collect())
    cited = (10, 1 << 30, "citation", None, "Source: A, T")
    assert got == [(10, 0, "page", None, None), (10, 1, "imageframe", 1, None), (10, 2, "mask", 2, None), (10, 3, "textbox", 3, None), cited, (11, 0, "page", None, None), (12, 0, "page", None, None), (12, 1, "mask", 6, None)]
    unmasked = impose.print_items(pages, documents, overlays, sources, solutions=True)
    assert sorted((r.pageid, r.z, r.kind) for r in unmasked.collect()) == [(10, 0, "page"), (10, 1, "imageframe"), (10, 2, "textbox"), (10, 1 << 30, "citation"), (11, 0, "page"), (12, 0, "page")]
