"""Setting of pages, cuts of markup and notes of HTML against plain loops on random input."""

import math
import random
from html import escape
from html.parser import HTMLParser

import pytest

from quire.functions import geometry as G
from quire.operators import blocks, flow, notes, typeset

PAGE = flow.AREA_BOTTOM - flow.AREA_TOP


class Letters(HTMLParser):
    """Characters of a piece of html with the tags open around each; fails where tags don't nest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img"):
            self.open.append((tag, *attrs))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.seen += [(c, tuple(self.open)) for c in data]


def letters(html):
    p = Letters()
    p.feed(html)
    p.close()
    assert not p.open
    return p.seen


def markup(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.55 or depth > 3:
            out.append(escape(" ".join(rng.choice(["word", "a", "R&D", "x<y", "longer-than-most", "é", "it's"]) for _ in range(rng.randrange(1, 9)))))
        elif kind < 0.65:
            out.append(rng.choice(["<br>", "<img src='a b.png'>", "<br/>"]))
        else:
            tag = rng.choice(["b", "em", "a", "span"])
            out.append(f"<{tag} class='c{rng.randrange(9)}'>{markup(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_cuts_are_the_last_space_and_keep_tags():
    rng, cuts = random.Random(2), 0
    for _ in range(2000):
        html, budget = f"<p>{markup(rng)}</p>", rng.randrange(5, 200)
        head, tail = typeset.cut_markup(html, budget)
        whole = letters(html)
        if not tail or not head:
            assert html in (head, tail)
            if tail:  # no cut: too small a budget, or no space in the stretch that reaches it
                stretch, at = [], 0
                for piece in typeset.TOKEN.findall(html):
                    if not piece.startswith("<"):
                        n = len(letters(piece))
                        if at + n >= budget:
                            stretch = [c for c, _ in letters(piece)][: budget - at]
                            break
                        at += n
                assert budget < 20 or " " not in stretch[1:]
            else:
                assert len(whole) < budget
            continue
        cuts += 1
        first, second = letters(head), letters(tail)
        n = len(first)
        assert n < budget and whole[n][0] == " " and all(c != " " for c, _ in whole[n + 1 : budget])
        assert whole[:n] == first and whole[n + 1 :] == second
    assert cuts > 300


def test_cut_column_is_the_function(spark):
    rng = random.Random(8)
    rows = [(f"<p>{markup(rng)}</p>", rng.randrange(10, 120)) for _ in range(200)] + [(None, 50), ("", None)]
    got = spark.createDataFrame(rows, "html string, n int").repartition(3).select("html", "n", typeset.split_markup("html", "n").alias("x")).select("html", "n", "x.head", "x.tail").collect()
    assert {tuple(r) for r in got} == {(h, n, *typeset.cut_markup(h or "", n or 0)) for h, n in rows}


def test_heights_as_expressions_are_those_of_the_setting(spark):
    rng, rows = random.Random(31), []
    for _ in range(300):
        tag, text = rng.choice(["h1", "h3", "h6", "p", "blockquote", "ul", "ol", "table", "pre"]), lambda: markup(rng).replace("&#x27;", "'")
        inner = {"ul": lambda: "".join(f"<li>{text()}</li>" for _ in range(rng.randrange(4))), "table": lambda: "".join("<tr>" + "".join(f"<td>{text()}</td>" for _ in range(rng.randrange(1, 5))) + "</tr>" for _ in range(rng.randrange(4))), "pre": lambda: "x\n" * rng.randrange(9)}
        rows.append((tag, f"<{tag}>{inner.get({'ol': 'ul'}.get(tag, tag), text)()}</{tag}>", rng.choice([0.3, 0.7952380952380952, 1.0])))
    got = spark.createDataFrame(rows, "tag string, html string, w double").repartition(4)
    for r in got.select("*", flow.html_height(got.tag, got.html, got.w).alias("h")).collect():
        assert abs(r.h - typeset.estimate(r.tag, r.html, r.w)) < 1e-9, r


def test_items_stay_whole():
    first, each, last = typeset.items("<ul class='x'><li>a<ul><li>b</li><li>c</li></ul></li> <li>d</li></ul>", "li")
    assert (first, each, last) == ("<ul class='x'>", ["<li>a<ul><li>b</li><li>c</li></ul></li>", "<li>d</li>"], "</ul>")
    table = "<table><thead><tr><th>h</th></tr></thead><tbody>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(40)) + "</tbody></table>"
    head, tail = typeset.cut_block("table", table, 0.3, 0.7)
    assert tail.startswith("<table><tr><th>h</th></tr><tr><td>") and head.count("<tr>") + tail.count("<tr>") == 42
    assert typeset.estimate("table", head, 0.7) <= 0.3 < typeset.estimate("table", head.replace("</table>", "<tr><td>z</td></tr></table>"), 0.7)
    assert typeset.cut_block("pre", "<pre>x</pre>", 1, 1) == ("", "<pre>x</pre>")


def set_by_loop(blocks, narrow=False, start=1, firstright=True, startright=False):
    """Where everything of one source goes: a list of (block, kind, page, side, x, y, w, h, html), by a loop of the rule."""
    edge = {"right": (G.NOTES_INNER if narrow else G.INNER) / G.PAGE_W, "left": (G.NOTES_OUTER if narrow else G.OUTER) / G.PAGE_W}
    column = {"right": (G.PAGE_W - G.NOTES_OUTER + G.NOTE_GAP) / G.PAGE_W, "left": G.NOTE_EDGE / G.PAGE_W}
    wide, line = flow.text_width(narrow), G.FONT * G.LINE / G.PAGE_H
    est_w, note_w = wide * (G.CHAR / G.SERIF if narrow else 1), flow.NOTE_W / G.NOTE_SCALE * (G.CHAR / G.SERIF)
    side = lambda p: "right" if (p % 2 == 1) == firstright else "left"
    at = start + (1 if startright and side(start) == "left" else 0)
    out, page, y, ny, wait, running, owed = [], 0, 0.0, 0.0, False, False, []

    def fresh():
        nonlocal page, y, ny, wait, running, owed, at
        page, y, ny, wait, running, at = page + 1, flow.AREA_TOP, flow.AREA_TOP, False, False, at + 1
        late, owed = owed, []
        margin(late)

    def margin(some):
        nonlocal ny
        some = list(some) if narrow else []
        while some:
            b, html, h = some[0]
            h = typeset.estimate("p", html, note_w) * G.NOTE_SCALE if h is None else h
            top = max(y, ny)
            if top > flow.AREA_TOP + 1e-9 and top + h > flow.AREA_BOTTOM + 1e-9:
                owed.extend((b, t, None) for b, t, _ in some)
                break
            out.append((b, "note", page, side(at - 1), column[side(at - 1)], top, flow.NOTE_W, min(h, flow.AREA_BOTTOM - top), html))
            ny = top + h + flow.GAP / 2
            some.pop(0)

    def line_up(b, html, h):
        nonlocal y, running
        out.append((b, "text", page, side(at - 1), edge[side(at - 1)], y, wide, h, html))
        y, running = y + h, True

    def end():
        nonlocal y, running
        y += flow.GAP if running else 0
        running = False

    def words(b, tag, html, beside, m):
        heads, ends, lh, done, given = tag in G.HEADINGS, m.get("lines"), m.get("lh"), 0, m.get("h")
        exact = bool(ends and lh)
        spare = max(0, (given or 0) - len(ends) * lh) if exact else 0
        while html:
            tall = (len(ends) - done) * lh + spare if exact else given if given is not None else typeset.estimate(tag, html, est_w)
            keep = 3 * ((m.get("blh") or lh) if exact else line) if heads else 0
            if page and not wait and y + tall + keep <= flow.AREA_BOTTOM + 1e-9:
                margin(beside)
                return line_up(b, html, tall)
            if not page or wait:
                fresh()
                continue
            given = None
            part, free = "", flow.AREA_BOTTOM - y
            if exact and tag in ("p", "blockquote"):
                n = math.floor((free - spare) / lh + 1e-9)
                if n >= 2 and len(ends) - done - n >= 2:
                    part, rest = typeset.cut_markup(html, ends[done + n - 1] - (ends[done - 1] if done else 0) + 1)
                    part, h = (part, n * lh + spare) if rest else ("", 0)
                    done += n if part else 0
            elif not exact and not heads and free >= 3 * line:
                part, rest = typeset.cut_block(tag, html, free, est_w)
                h = typeset.estimate(tag, part, est_w)
            if part:
                margin(beside)
                beside = []
                line_up(b, part, h)
                html = rest
                if not html:
                    return None
            if y <= flow.AREA_TOP + 1e-9:
                margin(beside)
                return line_up(b, html, min(tall, PAGE))
            fresh()
        return None

    for b, kind, tag, html, beside, w, h, caption, m in blocks:
        if kind == "pagebreak":
            wait = page > 0
        elif kind == "image":
            small, words_ = narrow and w <= 450, escape(caption or "")
            if small:
                if not page or wait:
                    fresh()
                fw, fh = flow.natural_size(w, h, flow.NOTE_W, math.inf)
                if max(y, ny) + fh > flow.AREA_BOTTOM:
                    end()
                    fresh()
                top = max(y, ny)
                out.append((b, "figure", page, side(at - 1), column[side(at - 1)], top, fw, min(fh, flow.AREA_BOTTOM - top), None))
                ny = top + fh + flow.GAP / 2
                if words_:
                    margin([(b, f"<p><em>{words_}</em></p>", None)])
            else:
                fw, fh = flow.natural_size(w, h, wide, PAGE)
                end()
                if not page or wait or (y > flow.AREA_TOP + 1e-9 and y + fh > flow.AREA_BOTTOM + 1e-9):
                    fresh()
                out.append((b, "image", page, side(at - 1), edge[side(at - 1)] + (wide - fw) / 2, y, fw, fh, None))
                y += fh + flow.GAP
                if words_:
                    words(b, "p", f'<p class="caption"><em>{words_}</em></p>', [], {})
        else:
            heights = m.get("notes") or []
            words(b, tag, html, [(b, n, heights[i] if i < len(heights) else None) for i, n in enumerate(beside or [])], m)
    while owed:
        fresh()
    return out


def drawn_source(rng):
    blocks = []
    for b in range(rng.randrange(1, 30)):
        kind = rng.random()
        if kind < 0.06:
            blocks.append((b, "pagebreak", None, None, None, None, None, None, {}))
        elif kind < 0.2:
            blocks.append((b, "image", None, None, None, rng.randrange(0, 2000), rng.randrange(0, 2500), rng.choice([None, "", "A <caption> " * rng.randrange(1, 9)]), {}))
        else:
            tag = rng.choice(["p", "p", "p", "blockquote", "h2", "ul", "table", "pre"])
            n = rng.choice([3, 30, 200, 900])
            text = " ".join(rng.choice(["word", "<b>strong stuff here</b>", "it", "longer"]) for _ in range(n))
            inner = {"ul": "".join(f"<li>{i} {text[: text.find('<')]}</li>" for i in range(n // 3)), "table": "<tr><th>h</th></tr>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(n // 3)), "pre": "x\n" * n}.get(tag, text)
            html = f"<{tag}>{inner}</{tag}>"
            m = {}
            if rng.random() < 0.4:
                m = {"h": rng.random() * 0.5}
            elif rng.random() < 0.5:
                ends = list(range(70, len(typeset.plain(html)), 70)) + [len(typeset.plain(html))]
                m = {"h": 0.017 * len(ends) + 0.01, "lh": 0.017, "lines": ends, "blh": rng.choice([None, 0.03])}
            beside = [f"<p>note {'long ' * rng.randrange(60)}</p>" for _ in range(rng.choice([0, 0, 0, 1, 3, 9]))]
            if m and beside and rng.random() < 0.5:
                m["notes"] = [rng.random() / 4 for _ in beside][: rng.randrange(1, 9)]
            blocks.append((b, "text", tag, html, beside, None, None, None, m))
    return blocks


@pytest.mark.parametrize("narrow", [False, True])
def test_pages_are_those_of_the_loop(spark, narrow):
    rng = random.Random(21)
    sources = {k: drawn_source(rng) for k in range(60)}
    starts = {k: (rng.randrange(1, 9), rng.random() < 0.5) for k in sources}
    rows = [(k, *b[:8]) for k, s in sources.items() for b in s]
    blocks = spark.createDataFrame(rows, "doc_id long, block_index int, kind string, tag string, html string, notes array<string>, width long, height long, caption string").repartition(7)
    measured = [(k, b[0], b[8].get("h"), b[8].get("lh"), b[8].get("blh"), b[8].get("lines"), b[8].get("notes")) for k, s in sources.items() for b in s if b[8]]
    m = spark.createDataFrame(measured, "doc_id long, block_index int, h double, lh double, blh double, lines array<int>, notes array<double>")
    given = spark.createDataFrame([(k, *v) for k, v in starts.items()], "doc_id long, start long, firstright boolean")
    placed = typeset.typeset(blocks, measures=m, starts=given, notes=narrow, startright=True)
    found = {}
    for r in placed.collect():
        found.setdefault(r.doc_id, []).append(r)
    for k, s in sources.items():
        want = set_by_loop(s, narrow, *starts[k], startright=True)
        rnd = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
        got = sorted((rnd((r.block_index, r.kind, r.page_no, r.side, r.x, r.y, r.w, r.h, r.html)) for r in found.get(k, [])), key=repr)
        assert got == sorted(map(rnd, want), key=repr), k
        for r in found.get(k, []):
            moved = starts[k][0] + (((starts[k][0] % 2 == 1) != starts[k][1]))
            assert r.position == moved + r.page_no - 1 and (r.side == "right") == ((r.position % 2 == 1) == starts[k][1])
            assert r.y >= flow.AREA_TOP - 1e-9 and (r.y + r.h <= flow.AREA_BOTTOM + 1e-9 or r.kind == "figure")
    pages = {}
    for f in typeset.frames(placed).collect():
        pages.setdefault((f.doc_id, f.page_no), []).append(f)
    for some in pages.values():  # frames of a column don't meet
        for column in (("text", "image"), ("note",) if narrow else ()):
            stack = sorted((f.y, f.h) for f in some if f.kind in column)
            assert all(a[0] + a[1] <= b[0] + flow.LINE_H + 1e-9 for a, b in zip(stack, stack[1:]))
            text = sorted((f.y, f.h, f.kind) for f in some if f.kind in column and f.h > flow.LINE_H + 1e-9)
            assert all(a[0] + a[1] <= b[0] + 1e-9 for a, b in zip(text, text[1:]))
    on = {(r.doc_id, r.page_no): r.blocks for r in typeset.flow_map(placed).collect()}
    assert set(on) == {(k, r.page_no) for k, some in found.items() for r in some} == set(pages)
    rows = typeset.with_fillers(typeset.page_rows(placed, notes=narrow, startright=True), given).collect()
    assert {(r.doc_id, r.position) for r in rows if r.filler} == {(k, v[0]) for k, v in starts.items() if k in found and (v[0] % 2 == 1) != v[1]}
    assert all(r.layoutside == "right" for r in rows if r.pinside == "right") and sum(r.pinside == "right" for r in rows) == len(found)


def test_probed_cases(spark):
    """A picture breaks a frame, a margin figure's caption stands beside, a height without lines counts, notes have pages of their own."""
    schema = "doc_id long, block_index int, kind string, tag string, html string, notes array<string>, width long, height long, caption string"
    one = spark.createDataFrame([(1, 0, "text", "p", "<p>a</p>", None, None, None, None), (1, 1, "image", None, None, None, 620, 600, ""), (1, 2, "text", "p", "<p>b</p>", None, None, None, None)], schema)
    made = sorted((f.y, f.kind) for f in typeset.frames(typeset.typeset(one)).collect())
    assert [k for _, k in made] == ["text", "image", "text"]
    side = spark.createDataFrame([(1, 0, "image", None, None, None, 300, 200, "Cap"), (1, 1, "text", "p", "<p>t</p>", None, None, None, None)], schema)
    assert sorted((r.kind, r.html) for r in typeset.typeset(side, notes=True).collect()) == [("figure", None), ("note", "<p><em>Cap</em></p>"), ("text", "<p>t</p>")]
    tall = spark.createDataFrame([(1, 0, 0.5)], "doc_id long, block_index int, h double")
    assert [r.h for r in typeset.typeset(side.where("block_index = 1").withColumn("block_index", side.block_index - 1), measures=tall).collect()] == [0.5]
    noted = spark.createDataFrame([(1, 0, "text", "p", "<p>t</p>", ["<p>" + "word " * 500 + "</p>"] * 3, None, None, None)], schema)
    placed = typeset.typeset(noted, notes=True)
    assert {r.page_no: r.blocks for r in typeset.flow_map(placed).collect()} == {1: [0], 2: [0], 3: [0]}
    assert typeset.typeset(noted.limit(0)).count() == 0


def drawn_page(rng):
    """(html, html with marks, notes) of a page made from parts that are known."""
    html, marked, found = [], [], []
    inline = lambda: rng.choice(["word", "<b>bold</b>", "<a href='#x'>link</a>", "<i>a <b>b</b></i>", "é &amp; so<br>"])
    lists = lambda: rng.choice(["<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "<p>para <span>x</span></p>", "just <em>text</em>"])
    feet, ends_p = [], False

    def mark(numbered, content):
        found.append((numbered, content))
        return "\0"

    for _ in range(rng.randrange(1, 9)):
        kind = rng.random()
        if kind < 0.55:
            tag, parts, shown = rng.choice(["p", "h2", "blockquote"]), [], []
            for _ in range(rng.randrange(1, 5)):
                x = inline()
                parts.append(x)
                shown.append(x)
                what = rng.random()
                if what < 0.2:
                    content = lists()
                    parts.append(f"<label class=\"margin-toggle\">+</label><span class='sidenote x'>{content}</span>")
                    shown.append(mark(True, content))
                elif what < 0.35:
                    k = len(feet)
                    feet.append(lists() + f" foot {k}")
                    parts.append(rng.choice([f"<sup><a href='#fn:{k}'>{k}</a></sup>", f'<a id="r" href="#fn:{k}">{k}</a>', f"<sup id='q'> <a href=#fn:{k}><b>{k}</b></a></sup>"]))
                    shown.append(mark(True, feet[k]))
                elif what < 0.45:
                    parts.append(rng.choice(["<span class='marginnote'>m <aside>in</aside></span>", "<span class=marginnote>m <aside>in</aside></span>"]))
                    shown.append(mark(False, "m <aside>in</aside>"))
                elif what < 0.5:
                    parts.append(rng.choice(["<span class='sidenote'> <b></b></span>", "<a href='#fn:none'>left</a>"]))
                    shown.append("" if "span" in parts[-1] else parts[-1])
            html.append(f"<{tag}>{''.join(parts)}</{tag}>")
            marked.append([f"<{tag}>{''.join(shown)}", f"</{tag}>"])
            ends_p = True
        elif kind < 0.8:
            content, tag = lists(), rng.choice(["aside", "div class='column-margin'", "section class=\"aside\""])
            html.append(f"<{tag}>{content}</{tag.split()[0]}>")
            m = mark(False, content)
            if ends_p:
                marked[-1][0] += m
            else:
                marked.append([f"<p>{m}", "</p>"])
                ends_p = True
        else:
            x = rng.choice(["<div>loose</div>", "<hr>", "<figure><img src='a'></figure>"])
            html.append(x)
            marked.append([x, ""])
            ends_p = False
    back = lambda k: rng.choice(["", f" <a href='#fnref:{k}'>back</a>", f"<a class='footnote-back' href='#z'>b</a>"])
    if feet:
        html.append("<section class='footnotes'><ol>" + "".join(f"<li id='fn:{k}'>{t}{back(k)}</li>" for k, t in enumerate(feet)) + "</ol></section>")
    text = "".join(a + b for a, b in marked)
    for k, (numbered, _) in enumerate(found):
        text = text.replace("\0", f"[[note:{k}{'n' if numbered else 'm'}]]", 1)
    return "".join(html), text, found


def test_notes_leave_their_marks():
    rng, n = random.Random(4), 0
    for _ in range(1500):
        html, text, found = drawn_page(rng)
        got = notes.cut_notes(html)
        assert got == (text, found), html
        n += len(found)
    assert n > 2000
    assert notes.cut_notes(None) == ("", [])
    assert notes.cut_notes("<p>a<aside>open") == ("<p>a<aside>open", [])
    assert notes.cut_notes("<p>open<aside>n</aside>more")[0] == "<p>open[[note:0m]]more"


def test_notes_go_to_blocks(spark):
    rows = [(1, "<aside>first</aside><p>a<span class='sidenote'>s</span></p><p>b</p><p>c<span class='sidenote'><p>t</p></span> end</p><aside>z</aside><hr style='page-break-after: always'><aside>late</aside>"), (2, "<aside>alone</aside>"), (3, None), (4, "no notes [[note:x]]")]
    got = notes.noted_blocks(spark.createDataFrame(rows, "id long, html string"), "id").orderBy("id", "block_index").collect()
    assert [(r.id, r.kind, r.html, r.notes) for r in got] == [
        (1, "text", "<p>a<sup>1</sup></p>", ["<p>first</p>", "<p><sup>1</sup> s</p>"]), (1, "text", "<p>b</p>", []), (1, "text", "<p>c<sup>2</sup> end</p>", ["<p><sup>2</sup> t</p>", "<p>z</p>", "<p>late</p>"]),
        (1, "pagebreak", None, []), (4, "text", "<p>no notes [[note:x]]</p>", []),
    ]


def test_markdown_becomes_html(spark):
    source = {
        1: "# A & B\ntext <x>\nmore\n\n- a\n- b\n\n::: {.column-margin}\nnote\n\n| h | i |\n|---|---|\n| 1 | 2 |\n:::\n\n1. one\n\\newpage\n> q",
        2: "```\n::: {.aside}\n:::\n<code>\n```\nafter",
        3: "::: {.aside}\nno end",
        4: "::::: {.aside}\nin\n:::\n:::\nlast",
        5: "",
    }
    rows = [(k, i, x) for k, t in source.items() for i, x in enumerate(t.split("\n"))]
    got = {r.documentid: r.html for r in blocks.markdown_html(spark.createDataFrame(rows, "documentid long, line_no int, line string").repartition(3)).collect()}
    assert got == {
        1: '<h1>A &amp; B</h1>\n<p>text &lt;x&gt; more</p>\n<ul><li>a</li><li>b</li></ul>\n<div class="column-margin"><p>note</p>\n<table><tr><td>h</td><td>i</td></tr><tr><td>1</td><td>2</td></tr></table></div>\n<ol><li>one</li></ol>\n<hr class="pagebreak">\n<blockquote>q</blockquote>',
        2: "<pre>::: {.aside}\n:::\n&lt;code&gt;</pre>\n<p>after</p>", 3: "<p>::: {.aside} no end</p>", 4: '<div class="column-margin"><p>in</p></div>\n<p>::: last</p>',
    }
