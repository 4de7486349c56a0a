"""Setting blocks of HTML onto left and right pages as frames.

A source is set block by block, which is a fold: its rows come in order to one task, which holds one
page. Heights are measured ones where given, else estimates from the characters of a line. Text runs
down a page in one frame until a picture or the page's end breaks it; paragraphs are cut at a space,
lists and tables between items, with all open tags closed and opened again. Notes and small pictures
go to the column beside the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.flow import AREA_BOTTOM, AREA_TOP, AROUND, EPS, GAP, LINE_H, NOTE_W, natural_size, text_width

SPARE = 1.05  # estimates are taken so much larger
# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TOKEN = re.compile(r"<[^>]*>|[^<]+|<")
TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)")
BLANKS = re.compile(r"[ \t\n\r\f\v]+")
MARKUP = re.compile(r"<[^>]*>")


def plain(html: str) -> str:
    """Text of a piece of html, blanks collapsed."""
    return BLANKS.sub(" ", entities.unescape(MARKUP.sub("", html))).strip(" ")


def cut_markup(html: str, budget: int) -> tuple[str, str]:
    """(head, tail) of html cut at the last space within ``budget`` characters of text; ('', html) where that can't be.

    Tags that are open at the cut are closed in the head and opened again, with their attributes, in
    the tail. The space goes. The stretch of text that reaches the budget must hold the space, and
    no cut is made under 20 characters; text that stays within the budget is all head.
    """
    if budget < 20:
        return "", html
    count, stack, at = 0, [], 0
    for m in TOKEN.finditer(html):
        token = m[0]
        tag = TAG.match(token)
        if tag:
            name = tag[2].lower()
            if tag[1]:
                if any(n == name for n, _ in stack):  # what an end tag leaves open inside goes with it
                    while stack.pop()[0] != name:
                        pass
            elif name not in VOID and not token.endswith("/>"):
                stack.append((name, token))
        elif not token.startswith("<!"):
            text = entities.unescape(token)
            if count + len(text) >= budget:
                space = text[: budget - count].rfind(" ")
                if space < 1:
                    return "", html
                head = html[:at] + entities.escape(text[:space]) + "".join(f"</{n}>" for n, _ in reversed(stack))
                return head, "".join(t for _, t in stack) + entities.escape(text[space + 1 :]) + html[m.end() :]
            count += len(text)
        at = m.end()
    return html, ""


def items(html: str, child: str) -> tuple[str, list[str], str]:
    """(start tag, outermost items, end tag) of a list or table; nested ones stay inside their item, table sections go."""
    m = re.match(r"(?s)(.*?<(\w+)[^>]*>)(.*)(</\2\s*>)\s*$", html)
    if not m:
        return "", [], ""
    inner, found, depth, start = re.sub(r"(?i)</?(?:thead|tbody|tfoot)\b[^>]*>", "", m[3]), [], 0, 0
    for t in re.finditer(rf"(?i)<(/?){child}\b[^>]*>", inner):
        if not t[1]:
            start, depth = (t.start(), 1) if depth == 0 else (start, depth + 1)
        elif depth:
            depth -= 1
            if depth == 0:
                found.append(inner[start : t.end()])
    return m[1], found, m[4]


def per_line(width: float, scale: float = 1.0) -> int:
    """Characters on a line, ten at least."""
    return max(10, math.floor(width * G.PAGE_W / (G.FONT * G.CHAR * scale)))


def estimate(tag: str, html: str, width: float) -> float:
    """Height of a text element in page units."""
    n = per_line(width)
    if tag in G.HEADINGS:
        scale = G.HEADINGS[tag]
        lines = math.ceil(len(plain(html)) / per_line(width, scale)) * scale + AROUND["heading"]
    elif tag in ("ul", "ol", "dl"):
        each = [m[0] for m in re.finditer(r"(?s)<(li|dt|dd)\b.*?</\1>", html)] or [html]
        lines = sum(max(1, math.ceil(len(plain(x)) / max(10, n - 4))) for x in each) + AROUND["list"]
    elif tag == "table":
        lines = AROUND["table"]
        for row in re.findall(r"(?s)<tr\b.*?</tr>", html):
            cells = re.findall(r"(?s)<t[dh]\b.*?</t[dh]>", row)
            room = max(4, n / max(1, len(cells)) - 2)
            lines += max([1, *(math.ceil(len(plain(c)) / room) for c in cells)]) + AROUND["row"]
    elif tag == "pre":
        lines = MARKUP.sub("", html).count("\n") + AROUND["pre"]
    else:
        lines = max(1, math.ceil(len(plain(html)) / n)) + AROUND["text"]
    return lines * LINE_H * SPARE


def cut_block(tag: str, html: str, height: float, width: float) -> tuple[str, str]:
    """(head, tail) of a block whose head is estimated to fit the height; ('', html) where nothing fits."""
    if tag in ("p", "blockquote"):
        return cut_markup(html, (math.floor(height / (LINE_H * SPARE)) - 1) * per_line(width))
    if tag not in ("ul", "ol", "table"):
        return "", html
    first, each, last = items(html, "tr" if tag == "table" else "li")
    n = 0
    while n < len(each) and estimate(tag, first + "".join(each[: n + 1]) + last, width) <= height:
        n += 1
    if n in (0, len(each)):
        return ("", html) if n == 0 else (html, "")
    again = each[:1] if tag == "table" and "<th" in each[0] else []
    return first + "".join(each[:n]) + last, first + "".join(again + each[n:]) + last


class _Setter:
    """Pages of one source; ``out`` takes (block, part, kind, placing, page, position, side, run, x, y, w, h, html)."""

    def __init__(self, notes: bool, position: int, firstright: bool, startright: bool) -> None:
        self.notes, self.firstright, self.position = notes, firstright, position
        if startright and self.side_of(position) != "right":
            self.position += 1
        self.factor = G.CHAR / G.SERIF if notes else 1.0
        self.width, self.page, self.side, self.y, self.note_y, self.broken, self.run, self.filled = text_width(notes), 0, "right", AREA_TOP, AREA_TOP, False, 0, False
        self.owed: list[tuple[int, str]] = []
        self.out: list[tuple] = []
        self.placing = self.part = 0

    def side_of(self, position: int) -> str:
        return "right" if (position % 2 == 1) == self.firstright else "left"

    @property
    def x(self) -> float:
        inner, outer = (G.NOTES_INNER, G.NOTES_OUTER) if self.notes else (G.INNER, G.OUTER)
        return (inner if self.side == "right" else outer) / G.PAGE_W

    @property
    def note_x(self) -> float:
        return (G.PAGE_W - G.NOTES_OUTER + G.NOTE_GAP if self.side == "right" else G.NOTE_EDGE) / G.PAGE_W

    def put(self, block: int, kind: str, x: float, y: float, w: float, h: float, html: str | None) -> None:
        self.out.append((block, self.part, kind, self.placing, self.page, self.position - 1, self.side, self.run if kind == "text" else None, x, y, w, h, html))
        self.part += 1

    def flush(self) -> None:
        """The frame ends; what follows begins a gap below."""
        if self.filled:
            self.y = self.y + GAP
            self.run += 1
        self.filled = False

    def turn(self) -> None:
        self.flush()
        self.side, self.page, self.position = self.side_of(self.position), self.page + 1, self.position + 1
        self.y, self.note_y, self.broken = AREA_TOP, AREA_TOP, False
        owed, self.owed = self.owed, []
        self.beside(owed, [])

    def beside(self, notes: list[tuple[int, str]], heights: list[float | None]) -> None:
        """notes (block, html) in the note column, each beside the line or below the one before; what has no room is owed to the next page."""
        for i, (block, html) in enumerate(notes if self.notes else []):
            given = heights[i] if i < len(heights) else None
            h = given if given is not None else estimate("p", html, NOTE_W / G.NOTE_SCALE * self.factor) * G.NOTE_SCALE
            top = max(self.y, self.note_y)
            if top + h > AREA_BOTTOM + EPS and top > AREA_TOP + EPS:
                self.owed += notes[i:]
                return
            self.put(block, "note", self.note_x, top, NOTE_W, min(h, AREA_BOTTOM - top), html)
            self.note_y = top + h + GAP / 2

    def add(self, block: int, html: str, h: float) -> None:
        self.put(block, "text", self.x, self.y, self.width, h, html)
        self.y, self.filled = self.y + h, True

    def fits(self, h: float) -> bool:
        return self.page > 0 and not self.broken and self.y + h <= AREA_BOTTOM + EPS

    def text(self, block: int, tag: str, html: str, notes: list[str], m: dict) -> None:
        """A text element; m holds what was measured: h, lh, blh, lines (ends in characters), notes (heights)."""
        beside, heights = [(block, n) for n in notes], m.get("notes") or []
        lines, lh, heading = m.get("lines") or [], m.get("lh") or 0.0, tag in G.HEADINGS
        exact = bool(lines and lh)
        extra = max(0.0, (m.get("h") or 0.0) - len(lines) * lh) if exact else 0.0
        body = (m.get("blh") or lh) if exact else LINE_H
        width, done, first = self.width * self.factor, 0, True
        while html:
            if exact:
                h = (len(lines) - done) * lh + extra
            else:
                h = m["h"] if first and m.get("h") is not None else estimate(tag, html, width)
            first = False
            if self.fits(h + (3 * body if heading else 0)):
                self.beside(beside, heights)
                self.add(block, html, h)
                return
            if not self.page or self.broken:
                self.turn()
                first = done == 0 and not exact and h == m.get("h")
                continue
            free, head, tall = AREA_BOTTOM - self.y, "", 0.0
            if exact:
                fit = math.floor((free - extra) / lh + EPS)
                if tag in ("p", "blockquote") and fit >= 2 and len(lines) - done - fit >= 2:
                    head, tail = cut_markup(html, lines[done + fit - 1] - (lines[done - 1] if done else 0) + 1)
                    head, tall = (head, fit * lh + extra) if tail else ("", 0.0)
                    done += fit if head else 0
            elif not heading and free >= 3 * LINE_H:
                head, tail = cut_block(tag, html, free, width)
                tall = estimate(tag, head, width)
            if head:
                self.beside(beside, heights)
                beside = []
                self.add(block, head, tall)
                html = tail
                if not html:
                    return
            if self.y <= AREA_TOP + EPS:  # too tall for an empty page
                self.beside(beside, heights)
                self.add(block, html, min(h, AREA_BOTTOM - AREA_TOP))
                return
            self.turn()

    def image(self, block: int, width: int, height: int, caption: str) -> None:
        words = entities.escape(caption)
        if self.notes and width <= G.MARGIN_FIGURE:
            if not self.page or self.broken:
                self.turn()
            w, h = natural_size(width, height, NOTE_W, math.inf)
            if max(self.y, self.note_y) + h > AREA_BOTTOM:
                self.turn()
            top = max(self.y, self.note_y)
            self.put(block, "figure", self.note_x, top, w, min(h, AREA_BOTTOM - top), None)
            self.note_y = top + h + GAP / 2
            if words:
                self.beside([(block, f"<p><em>{words}</em></p>")], [])
            return
        w, h = natural_size(width, height, self.width, AREA_BOTTOM - AREA_TOP)
        self.flush()
        if not self.page or self.broken or self.y + h > AREA_BOTTOM + EPS and self.y > AREA_TOP + EPS:
            self.turn()
        self.put(block, "image", self.x + (self.width - w) / 2, self.y, w, h, None)
        self.y += h + GAP
        if words:
            self.text(block, "p", f'<p class="caption"><em>{words}</em></p>', [], {})

    def finish(self) -> None:
        """Notes that are still owed get pages of their own."""
        while self.owed:
            self.turn()


PLACED = "block_index long, part int, kind string, placing long, page_no int, position long, side string, run int, x double, y double, w double, h double, html string"
_IN = ("k", "block_index", "kind", "tag", "html", "notes", "width", "height", "caption", "m_h", "m_lh", "m_blh", "m_lines", "m_notes", "start", "firstright")


def typeset(blocks: DataFrame, key: str = "doc_id", measures: DataFrame | None = None, starts: DataFrame | None = None, notes: bool = False, startright: bool = False) -> DataFrame:
    """(key, block_index, part, kind, placing, page_no, position, side, run, x, y, w, h, html): everything that stands on a page.

    blocks (key, block_index, kind, tag, html; notes, width, height, caption if they have them), kind
    text, image or pagebreak. measures (key, block_index; h, lh, blh, lines, notes) replace estimates
    where given: with lines and lh paragraphs are cut exactly at a line with two lines on either side, else
    h counts until the block is cut. starts (key, start, firstright): the position of the first page (1) and
    whether position 1 is a right page (true). With ``notes`` the narrow style is set, with its column
    on the outer side. With ``startright`` a first page that would be left moves on by one.

    kind is text, image, figure (a small image in the note column) or note. Text of one ``run`` is one frame;
    ``placing`` is the block that was being set, which for a note carried to another page is a later one.
    Headings keep room for three lines; what fits no empty page is placed there, clipped. No text is lost; a
    table's heading row is repeated. A page break counts only once a page is open. Blocks with a null or
    empty html take no place; a null size counts as 0. Sources without blocks have no rows.
    """
    have = {c.lower() for c in blocks.columns}
    given = lambda d, c, kind: (F.col(c) if c in d else F.lit(None)).cast(kind)
    b = blocks.select(
        F.col(key).alias("k"), F.col("block_index").cast("long").alias("block_index"), "kind", "tag", "html", given(have, "notes", "array<string>").alias("notes"),
        given(have, "width", "long").alias("width"), given(have, "height", "long").alias("height"), given(have, "caption", "string").alias("caption"),
    )
    names = {"h": "double", "lh": "double", "blh": "double", "lines": "array<int>", "notes": "array<double>"}
    if measures is not None:
        there = {c.lower() for c in measures.columns}
        m = measures.select(F.col(key).alias("k"), F.col("block_index").cast("long").alias("block_index"), *[given(there, c, kind).alias(f"m_{c}") for c, kind in names.items()])
        b = b.join(m, ["k", "block_index"], "left")
    else:
        b = b.withColumns({f"m_{c}": F.lit(None).cast(kind) for c, kind in names.items()})
    if starts is not None:
        b = b.join(starts.select(F.col(key).alias("k"), F.col("start").cast("long").alias("start"), "firstright"), "k", "left")
    else:
        b = b.withColumns({"start": F.lit(1).cast("long"), "firstright": F.lit(True)})
    kind = b.schema["k"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        plain_types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        fields = [x.split() for x in PLACED.split(", ")]
        now, setter, key_type, done = None, None, None, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * (len(fields) + 1)
            types = [key_type, *(plain_types[t] for _, t in fields)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", *(n for n, _ in fields)])

        def moved() -> None:
            done.extend((now, *row) for row in setter.out)
            setter.out.clear()

        for batch in batches:
            key_type = batch.schema.field("k").type
            for row in zip(*(batch.column(c).to_pylist() for c in _IN)):
                r = dict(zip(_IN, row))
                if setter is None or r["k"] != now:
                    if setter is not None:
                        setter.finish()
                        moved()
                    now, setter = r["k"], _Setter(notes, 1 if r["start"] is None else r["start"], r["firstright"] is not False, startright)
                setter.placing, setter.part = r["block_index"], 0
                if r["kind"] == "pagebreak":
                    setter.broken = setter.page > 0
                elif r["kind"] == "image":
                    setter.image(r["block_index"], r["width"] or 0, r["height"] or 0, r["caption"] or "")
                elif r["html"]:
                    setter.text(r["block_index"], r["tag"] or "p", r["html"], r["notes"] or [], {c: r[f"m_{c}"] for c in names})
            if setter is not None:
                moved()
            yield packed()
        if setter is not None:
            setter.finish()
            moved()
            yield packed()

    return b.select(*_IN).repartition("k").sortWithinPartitions("k", "block_index").mapInArrow(run, f"k {kind}, {PLACED}").withColumnRenamed("k", key)


def shown_blocks(blocks: DataFrame, hidden: DataFrame, adopted: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks without those that are hidden or adopted (key, block_index), and without images that have no data (a column ``filename`` or ``data`` that is null)."""
    gone = hidden.select(key, "block_index").unionByName(adopted.select(key, "block_index")).distinct()
    left = blocks.join(gone, [key, "block_index"], "left_anti")
    for c in ("filename", "data"):
        if c in left.columns:
            left = left.where(F.coalesce(F.col("kind") != "image", F.lit(True)) | F.col(c).isNotNull())
    return left


def frames(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, side, kind, x, y, w, h, html, block_index): a row for each frame of each page.

    A run of text is one frame, from its first top to its last bottom (at most the type area's), at least a line high, its
    parts joined by a line end; pictures, figures and notes are frames of their own. block_index is the first block's.
    """
    columns = ["side", "kind", "x", "y", "w", "h", "html", "block_index"]
    text = F.col("kind") == "text"
    d = placed.where("kind IS NOT NULL").groupBy(key, "page_no", text.alias("text"), F.when(text, F.col("run")).alias("run")).agg(
        F.first("side").alias("side"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("w").alias("w"), F.max(F.col("y") + F.col("h")).alias("end"),
        F.array_sort(F.collect_list(F.when(text, F.struct("block_index", "part", "html")))).alias("parts"), F.min("block_index").alias("block_index"),
        F.collect_list(F.when(~text, F.struct(*columns))).alias("others"),
    )
    h = F.greatest(F.least("end", F.lit(AREA_BOTTOM)) - F.col("y"), F.lit(LINE_H))
    html = F.array_join(F.transform("parts", lambda r: r["html"]), "\n")
    one = F.struct("side", F.lit("text").alias("kind"), "x", "y", "w", h.alias("h"), html.alias("html"), "block_index")
    return d.select(key, "page_no", F.explode(F.when(F.col("text"), F.array(one)).otherwise(F.col("others"))).alias("r")).select(key, "page_no", "r.*")


def flow_map(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, blocks): the distinct blocks that were being set on each page, in order; pages with nothing but notes too."""
    return placed.groupBy(key, "page_no").agg(F.array_sort(F.collect_set("placing")).alias("blocks"))


def page_rows(placed: DataFrame, key: str = "doc_id", notes: bool = False, startright: bool = False, staged: bool = False) -> DataFrame:
    """(key, page_no, position, layoutside, pagestyle, pinside, filler, staged): the pages that hold something.

    With ``startright`` the first page is pinned to the right, and a source whose first page moved on has a filler
    (page_no 0) before it, unless its pages are staged. ``placed`` must come from the same settings.
    """
    pages = placed.groupBy(key, "page_no").agg(F.first("position").alias("position"), F.first("side").alias("layoutside"))
    style: Column = F.lit("tufte" if notes else None).cast("string")
    first = F.lit(startright) & (F.col("page_no") == 1)
    out = pages.select(key, "page_no", "position", "layoutside", style.alias("pagestyle"), F.when(first, "right").alias("pinside"), F.lit(False).alias("filler"), F.lit(staged).alias("staged"))
    return out


def with_fillers(pages: DataFrame, starts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages of :func:`page_rows`, with a filler before first pages that moved on from their start (starts: key, start)."""
    moved = pages.where("page_no = 1").join(starts.select(key, "start"), key).where("position > start AND NOT staged")
    side = F.when(F.col("layoutside") == "right", "left").otherwise("right")
    return pages.unionByName(moved.select(key, F.lit(0).alias("page_no"), (F.col("position") - 1).alias("position"), side.alias("layoutside"), "pagestyle", F.lit(None).cast("string").alias("pinside"), F.lit(True).alias("filler"), "staged"))


def split_markup(html: Column | str, budget: Column | str) -> Column:
    """struct<head, tail> of :func:`cut_markup` for a column of html; null html is empty, a null budget cuts nothing."""
    @F.pandas_udf("head string, tail string")
    def cut(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_markup(t, n) for t, n in zip(texts, most)], columns=["head", "tail"])

    column = lambda c: F.col(c) if isinstance(c, str) else c
    return cut(F.coalesce(column(html), F.lit("")), F.coalesce(column(budget), F.lit(0)).cast("int"))


def html_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_index, kind, tag, html): lines of plain documents as blocks, the first a heading, empty ones left out."""
    d = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("block_index", "text")).where("trim(text) <> ''")
    tag = F.when(F.col("block_index") == 0, "h1").otherwise("p")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return d.select(id_col, "block_index", F.lit("text").alias("kind"), tag.alias("tag"), F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")).alias("html"))
