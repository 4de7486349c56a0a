"""Exact values and properties of single operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import ranges as R
from quire.functions import text as T
from quire.operators import blocks, flow, impose, order, overlay, provenance

PAGE = "documentid long, id long, sortorder int, sourceid long, pagetype string, width int, height int, landscapelock boolean, spreadid long, spreadside string, pinside string, filler boolean, staged boolean, layoutside string"


def page(i, document=1, kind="image", spread=None, side=None, pin=None, filler=False, staged=False, wide=False, layout=None, source=1):
    return (document, i, i, source, kind, 1754 if wide else 1240, 1240 if wide else 1754, wide, spread, side, pin, filler, staged, layout)


def documents(spark, right=True):
    return spark.createDataFrame([(1, right)], "id long, firstpageright boolean")


def plain_range(expr, total):
    """(valid, numbers) of a range; the rule as a loop."""
    if not (expr or "").strip():
        return True, list(range(1, total + 1))
    out, valid = set(), True
    for part in expr.split(","):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if not (first.isdigit() and int(first) and (last.isdigit() or not last)):
            valid = False
            continue
        end = int(last) if last else total if dash else int(first)
        valid &= not last or end >= int(first)
        out |= {n for n in range(int(first), end + 1) if n <= total}
    return valid, sorted(out) if valid else list(range(1, total + 1))


def drawn_ranges():
    rnd = random.Random(17)
    number = lambda: str(rnd.choice([0, *range(1, 24)]))
    part = lambda: rnd.choice([number, lambda: f"{number()}-", lambda: f" {number()} -{number()}", lambda: rnd.choice(["", "x", "3-y", "-"])] + [number] * 3)()
    return [(",".join(part() for _ in range(rnd.randrange(1, 5))), rnd.randrange(0, 20)) for _ in range(200)] + [(None, 6), (" ", 5)]


def test_ranges_equal_the_loop(spark):
    drawn = drawn_ranges()
    d = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(drawn)], "i int, e string, t int")
    r = d.select("i", R.range_valid(F.col("e")).alias("v"), R.parse_range(F.col("e"), F.col("t")).alias("n"), F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: R.in_range(F.col("e"), k, F.col("t"))).alias("m")).orderBy("i").collect()
    assert [(x.v, x.n) for x in r] == [plain_range(e, t) for e, t in drawn]
    assert [[k + 1 for k, inside in enumerate(x.m) if inside] for x in r] == [plain_range(e, t)[1] for e, t in drawn]


def folded(layout, n, right):
    """Sides of slots as one gets them by folding or filling sheets by hand; 0 is an empty slot."""
    seq = ([] if right or layout != "booklet" else [0]) + list(range(1, n + 1))
    if layout != "booklet":
        slots = impose.PER_SIDE[layout]
        seq = ([0] if right and slots > 1 else []) + seq
        seq += [0] * (-len(seq) % slots)
        return [seq[i : i + slots] for i in range(0, len(seq), slots)]
    stack, out = seq + [0] * (-len(seq) % 4), []
    while stack:
        out.append([stack.pop(), stack.pop(0)])
        out.append([stack.pop(0), stack.pop()])
    return out


@pytest.mark.parametrize("layout", impose.PER_SIDE)
def test_sheets(spark, layout):
    cases = [(n, right) for n in (1, 2, 3, 4, 7, 8, 9, 13) for right in (True, False)]
    rows = [(i, k, right) for i, (n, right) in enumerate(cases) for k in range(1, n + 1)]
    got = {(r.documentid, r.side_no, r.slot_no): r.position or 0 for r in impose.impose(spark.createDataFrame(rows, "documentid long, position long, startright boolean"), layout).collect()}
    assert got == {(i, s, k): p for i, case in enumerate(cases) for s, side in enumerate(folded(layout, *case)) for k, p in enumerate(side)}


def test_sides(spark):
    rows = spark.createDataFrame([(1, True), (2, True), (1, False)], "p int, f boolean").select(G.side(F.col("p"), F.col("f")).alias("s")).collect()
    assert [r.s for r in rows] == ["right", "left", "left"]


def test_spread_rows(spark):
    d = spark.createDataFrame([page(i, wide=i == 5) for i in range(1, 8)], PAGE)
    rows = order.spreads(order.rebalance(d, documents(spark))).orderBy("position").collect()
    assert [r.row_no for r in rows] == [1, 2, 2, 3, 4, 5, 5]


def looped(pages, right):
    """Side balancing page by page."""
    out, at = [], 0
    for i, required in pages:
        at += 1
        if required and ("right" if (at % 2 == 1) == right else "left") != required:
            out.append((at, None))
            at += 1
        out.append((at, i))
    return out


def test_balancing_equals_the_loop(spark):
    rnd, rows, want = random.Random(2), [], {}
    for d in range(60):
        mine = [(d * 100 + k, rnd.choice([None, None, "left", "right"])) for k in range(rnd.randrange(1, 14))]
        rows += [page(i, document=d, pin=p) for i, p in mine]
        want[d] = looped(mine, d % 2 == 0)
    docs = spark.createDataFrame([(d, d % 2 == 0) for d in range(60)], "id long, firstpageright boolean")
    got = {d: [] for d in want}
    for r in order.balanced_pages(spark.createDataFrame(rows, PAGE), docs).collect():
        got[r.documentid].append((r.position, r.id))
    assert {d: sorted(x) for d, x in got.items()} == want


def test_move_keeps_spreads_together(spark):
    p = [page(1), page(2), page(3, spread=3, side="left"), page(4, spread=3, side="right")]
    cmd = spark.createDataFrame([(1, 4, True)], "documentid long, id long, up boolean")
    assert [r.id for r in order.move_units(spark.createDataFrame(p, PAGE), cmd).orderBy("position").collect()] == [1, 3, 4, 2]


def test_pins_and_unlink(spark):
    d = spark.createDataFrame([page(1, spread=1, side="left"), page(2, spread=1, side="right"), page(3)], PAGE)
    pins = spark.createDataFrame([(1, "left"), (3, "right")], "id long, pin string")
    assert [r.pinside for r in order.set_pins(d, pins).orderBy("id").collect()] == [None, None, "right"]
    assert [r.spreadid for r in order.unlink(d, d.where("id = 1").select("spreadid")).orderBy("id").collect()] == [None] * 3


def test_boxes_and_settings(spark):
    d = spark.createDataFrame([(1, "textbox", '{"fontsize": 500, "color": "red"}'), (2, "mask", None), (3, "magic", "{}")], "id long, overlaytype string, data string")
    d = d.selectExpr("*", "cast(0.1 as decimal(10,6)) x", "cast(0.2 as decimal(10,6)) y", "cast(2 as decimal(10,6)) w", "cast(0.1 as decimal(10,6)) h")
    assert float(overlay.clamped(d).first().w) == 0.9
    got = {r.id: r.settings for r in overlay.clean_settings(d).collect()}
    assert got == {1: '{"text":"","fontsize":96,"bold":false,"color":"#000000","bgcolor":"#ffffff","align":"left"}', 2: '{"style":"white","revealable":false,"label":""}'}
    more = [("textbox", '{"text": "a <b>c</b>", "fontsize": "x", "bold": 1, "bgcolor": " #ABCDEF ", "align": "center"}', {"text": "a c", "fontsize": 6, "bold": True, "color": "#000000", "bgcolor": "#abcdef", "align": "center"}), ("audio", '{"ttslang": "fr-CA", "filename": "../u/v.mp3"}', {"mode": "file", "ttstext": "", "ttslang": "fr-CA", "label": "", "filename": "uv.mp3"}), ("textframe", '{"fontscale": 9, "columns": 0, "html": "<p>t</p><script>x</script>"}', {"html": "<p>t</p>", "fontscale": 3.0, "bgcolor": "", "border": False, "columns": 1, "style": ""}), ("column", "no json", {})]
    rows = spark.createDataFrame([(i, t, j) for i, (t, j, _) in enumerate(more)], "id long, overlaytype string, data string")
    assert [json.loads(r.settings) for r in overlay.clean_settings(rows).orderBy("id").collect()] == [want for *_, want in more]


URLS = [("/logo.svg", "https://press.test/logo.svg"), ("../../up.gif", "https://press.test/up.gif"), ("./near/x.jpg", "https://press.test/books/nine/near/x.jpg"), ("//files.test/y?z=1", "https://files.test/y?z=1"), ("mailto:desk@press.test", None), ("JavaScript:print()", None), ("data:text/plain,hi", None), ("#note3", "https://press.test/books/nine/text.htm?v=4#note3"), ("?v=5", "https://press.test/books/nine/text.htm?v=5"), ("notes/", "https://press.test/books/nine/notes/"), ("http://else.test/", "http://else.test/")]


@pytest.mark.parametrize("rel,want", URLS)
def test_absolute_url(spark, rel, want):
    d = spark.createDataFrame([("https://press.test/books/nine/text.htm?v=4#end", rel)], "b string, r string")
    assert d.select(T.absolute_url(F.col("b"), F.col("r")).alias("u")).first().u == want


def test_attributes(spark):
    d = spark.createDataFrame([("""lang=de-AT .Recto KIND="lower third" lang=it #plate-3 .verso""",)], "t string")
    r = d.select(T.attribute_map(F.col("t")).alias("a")).first().a
    assert r.classes == ["Recto", "verso"] and r.id == "plate-3" and r.attrs == {"lang": "it", "kind": "lower third"}


def test_text_functions(spark):
    d = spark.createDataFrame([("![a](x.png){width=40%} ![b](y.png)", "## Head\nrest", "berschrift2", "text/html; charset=ISO-8859-1", "page10.png")], "i string, c string, s string, t string, n string")
    r = d.select(T.image_refs(F.col("i")).alias("i"), T.callout_title(F.lit(""), F.col("c"), "Note").alias("c"), T.word_heading(F.col("s")).alias("s"), T.charset(F.col("t"), F.lit("")).alias("t"), (T.natural_key(F.lit("Page2.png")) < T.natural_key(F.col("n"))).alias("n")).first()
    assert [(x.alt, x.src, x.attrs) for x in r.i] == [("a", "x.png", "width=40%"), ("b", "y.png", "")]
    assert (r.c.title, r.c.body, r.s, r.t, r.n) == ("Head", "rest", "h3", "iso-8859-1", True)


@pytest.mark.parametrize("html, want", [
    ("<p onclick=\"x()\" class='a'>t</p>", "<p class='a'>t</p>"), ("<a href=\"javascript:x\">l</a><a href='/p?a=1&amp;b'>m</a>", "<a>l</a><a href='/p?a=1&amp;b'>m</a>"),
    ("<a href=\"&#106;avascript:x\" title=\">\" onmouseover=\"y\">l</a>", "<a title=\">\">l</a>"), ("<img src=\"data:image/png;base64,aa\" onerror=x><img src='data:text/html,x'>", "<img src=\"data:image/png;base64,aa\"><img>"),
    ("a < b <custom>c</custom><!-- <b> --><b>d</b><script>e</script>", "a &lt; b c<b>d</b>"), ("<B STYLE='x'>t</B><br/><a href=\"x.html\">r</a><a href=\"a:b\">s</a>", "<b>t</b><br><a href=\"x.html\">r</a><a>s</a>"), ("<p x", "&lt;p x"), ("", ""),
])
def test_purified(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(T.purified(F.col("h"))).first()[0] == want


def test_html_blocks(spark):
    html = "<body><div><h2>Title</h2><p>One <b>two</b><p>three</p></div>loose<ul><li>a<li><p>b</p></ul><table><tr><td>x</td></tr></table></body>"
    got = blocks.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_index").collect()
    assert [(r.tag, r.text) for r in got] == [("h2", "Title"), ("p", "One two"), ("p", "three"), ("p", "loose"), ("ul", "a b"), ("table", "x")]


def test_markdown_blocks(spark):
    lines = ["# Titel", "", "Text *so*", "weiter", "", "\\newpage", "- a", "- b", "```", "# kein", "```"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "documentid long, line_no int, line string")
    assert [r.tag for r in blocks.markdown_blocks(d).orderBy("block_index").collect()] == ["h1", "p", "pagebreak", "ul", "pre"]


def test_selector_is_checked(spark):
    d = spark.createDataFrame([(1, "<main><p>a</p></main><div id='content'><p>b</p></div><p>c</p>")], "page_id long, html string")
    assert blocks.select_root(d, "#content").first().text == "b" and blocks.select_root(d, ".none").first().text == "a"
    with pytest.raises(ValueError):
        blocks.select_root(d, 'main"] or @*["')


def test_line_breaks(spark):
    d = spark.createDataFrame([("aa bb  cc\ndd e",)], "t string")
    assert d.select(flow.line_breaks(F.col("t"), 5).alias("e")).first().e == [5, 11, 13]


def test_glossary_of_each_term(spark):
    e = spark.createDataFrame([(4, 1, "Tide", "Ebb", False), (7, 1, "Current", "TIDE", True), (9, 1, "tide", None, True), (3, 2, "Tide", None, True)], "id long, glossaryid int, concept string, alias string, approved boolean")
    asked = spark.createDataFrame([(1, "tIDE"), (2, "tIDE"), (2, "ebb"), (3, "tide")], "glossaryid int, term string")
    assert sorted(map(tuple, provenance.glossary_lookup(asked, e).collect())) == [(1, "tIDE", 7), (2, "tIDE", 3)]


def test_job_result(spark):
    f = spark.createDataFrame([(1, 1, 1, None), (1, 2, 0, "bad.txt"), (2, 1, 0, "x.txt")], "job long, file_no int, pages int, error string")
    assert sorted(tuple(r) for r in provenance.job_result(f).collect()) == [(1, 1, "bad.txt", "done"), (2, 0, "x.txt", "failed")]


def test_publishing_edits(spark):
    from quire.operators import publish

    d = spark.createDataFrame([(1, "see http://s/d?id=5 and http://s/d?id=6")], "id long, text string").withColumn("text", T.portable_links(F.col("text"), "http://s/d?id="))
    assert d.first().text == "see @@DOC*5@@ and @@DOC*6@@"
    assert publish.decoded_links(d, spark.createDataFrame([(5, 50)], "old long, new long")).first().text == "see 50 and "
    b = spark.createDataFrame([(1, 0, "a.png", bytearray(b"x")), (1, 1, None, None)], "sourceid long, block_index int, filename string, data binary")
    rows, media = publish.split_media(b)
    assert [bytes(r.data) for r in publish.joined_media(rows, media).orderBy("block_index").collect()] == [b"x", b""]
    s = spark.createDataFrame([(1, "lines", 99, False), (2, "magic", 0, True)], "id long, template string, count int, landscape boolean")
    got = publish.worksheet_lines(s).groupBy("id").agg(F.countDistinct("page_no").alias("p"), F.count("*").alias("n")).collect()
    assert [(r.id, r.p, r.n) for r in got] == [(1, 50, 50 * 33)]
    o = spark.createDataFrame([(1, 1, "mask", 0.1, 0.1, 0.1, 0.1, "a", 3)], "id long, pageid long, overlaytype string, x double, y double, w double, h double, data string, sortorder int")
    c = spark.createDataFrame([(1, 2, "audio", 0.5, None, None, None, None), (9, 1, "mask", 0.75, 0.0, 1.0, 1.0, "{}"), (8, 1, "audio", 0.0, 0.0, 0.5, 0.5, '{"filename":"own.mp3"}')], "id long, pageid long, overlaytype string, x double, y double, w double, h double, data string")
    r = publish.upsert_overlays(o, c).orderBy("id").collect()
    assert (r[0].pageid, r[0].overlaytype, r[0].x, r[0].data, r[0].sortorder) == (1, "mask", 0.1, "a", 3)  # another type: left out
    assert [(x.id, x.sortorder) for x in r[1:]] == [(8, 4), (9, 5)] and r[2].w == 0.25 and '"filename":""' in r[1].data
    same = spark.createDataFrame([(1, 2, "mask", None, 0.5, None, None, None)], "id long, pageid long, overlaytype string, x double, y double, w double, h double, data string")
    r = publish.upsert_overlays(o, same).first()
    assert (r.pageid, r.x, r.y, r.data, r.sortorder) == (2, 0.1, 0.5, "a", 3)
    p = spark.createDataFrame([(1, True), (3, True)], "id long, filler boolean")
    assert [x.filler for x in publish.filled_pages(p, same.unionByName(c)).orderBy("id").collect()] == [False, True]


def plain_links(pages, named):
    """Commands one after the other on a list of (id, filler, spread); the rule as a loop."""
    pages = [dict(zip(("id", "filler", "spread"), p)) for p in pages]
    for i in [p["id"] for p in pages]:
        kept = [p for p in pages if not p["filler"]]
        for k, p in enumerate(kept[:-1]):
            if i in named and p["id"] == i and p["spread"] is None and kept[k + 1]["spread"] is None:
                p["spread"] = kept[k + 1]["spread"] = i
                break
    return {p["id"]: p["spread"] for p in pages}


def test_links_equal_the_loop(spark):
    rnd = random.Random(9)
    for _ in range(6):
        raw = [(i, rnd.random() < 0.2, rnd.choice([None, None, None, 900 + i])) for i in range(1, 14)]
        named = {i for i in range(1, 14) if rnd.random() < 0.7}
        d = spark.createDataFrame([page(i) for i, *_ in raw], PAGE)
        state = spark.createDataFrame(raw, "id long, f boolean, s long")
        d = d.join(state, "id").withColumn("filler", F.col("f")).withColumn("spreadid", F.col("s")).drop("f", "s")
        got = {r.id: r.spreadid for r in order.link_spreads(d, spark.createDataFrame([(i,) for i in named] or [(0,)], "id long")).collect()}
        assert got == plain_links(raw, named)
