"""Estimates and measures of blocks, as expressions; the pages themselves are set in typeset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T

EPS = 1e-9
AREA_TOP, AREA_BOTTOM = G.TOP / G.PAGE_H, 1 - G.BOTTOM / G.PAGE_H
GAP = G.GAP / G.PAGE_H
TEXT_W = (G.PAGE_W - G.INNER - G.OUTER) / G.PAGE_W
NOTE_W = (G.NOTES_OUTER - G.NOTE_GAP - G.NOTE_EDGE) / G.PAGE_W
ASPECT = G.PAGE_W / G.PAGE_H
LINE_H = G.FONT * G.LINE / G.PAGE_H


def text_width(notes: bool) -> float:
    """Width of the text, in page units, with or without a column of notes."""
    return (G.PAGE_W - G.NOTES_INNER - G.NOTES_OUTER) / G.PAGE_W if notes else TEXT_W


def item_lines(tag: Column, text: Column, width: float = TEXT_W) -> Column:
    """Array of the estimated lines of each item (row of the text) of a list or table."""
    n = G.chars_per_line(F.lit(width), F.lit(1.0)) - F.when(tag == "table", 0).otherwise(4)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / n)).cast("long"))


def block_lines(tag: Column, text: Column, width: float = TEXT_W) -> Column:
    """Estimated lines of a block's plain text: items and rows of lists, tables and pre are lines of the text."""
    scale = F.lit(1.0)
    for h, s in G.HEADINGS.items():
        scale = F.when(tag == h, s).otherwise(scale)
    cpl = G.chars_per_line(F.lit(width), scale)
    rows = F.split(text, "\n")
    per = lambda n: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.lit(1), F.ceil(F.length(x) / n)))
    return F.when(tag == "pre", F.size(rows).cast("long")).when(tag.isin("ul", "ol"), per(cpl - 4)).when(tag == "table", per(cpl)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / cpl))).cast("long")


def block_height(tag: Column, text: Column, width: float = TEXT_W) -> Column:
    """Estimated height in page units, with 5 % to spare."""
    scale = F.lit(1.0)
    for h, s in G.HEADINGS.items():
        scale = F.when(tag == h, s).otherwise(scale)
    return block_lines(tag, text, width) * G.line_height(1.0) * scale * 1.05


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_index, tag, text): lines of plain documents, the first a heading, empty ones left out."""
    d = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("block_index", "text"))
    return d.where("text <> ''").withColumn("tag", F.when(F.col("block_index") == 0, "h1").otherwise("p"))


def line_breaks(text: Column, width: int) -> Column:
    """Greedy lines of collapsed text: array of each line's end, in characters of the collapsed text."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("line"))

    def step(acc: Column, w: Column) -> Column:
        n = F.length(w)
        fits = (acc["line"] == 0) | (acc["line"] + 1 + n <= width)
        at = F.when(acc["at"] == 0, n).otherwise(acc["at"] + 1 + n)
        return F.struct(F.when(fits, acc["ends"]).otherwise(F.concat(acc["ends"], F.array(acc["at"]))).alias("ends"), at.alias("at"), F.when(acc["line"] == 0, n).when(fits, acc["line"] + 1 + n).otherwise(n).alias("line"))

    return F.aggregate(words, start, step, lambda acc: F.concat(acc["ends"], F.array(acc["at"])))


def natural_size(width: int, height: int, most: float, tallest: float) -> tuple[float, float]:
    """(w, h) of an image of so many pixels at 150 dpi in page units: no wider than ``most``, at most 0.9 of ``tallest`` high."""
    w = min(most, width / G.CANVAS[0])
    h = w * height / max(1, width) * ASPECT
    if h > 0.9 * tallest:
        h = 0.9 * tallest
        w = h / ASPECT * width / max(1, height)
    return w, h


def natural_frame(width: Column, height: Column, most: Column, tallest: Column) -> Column:
    """struct (w, h): natural_size as an expression."""
    w = F.least(most, width / G.CANVAS[0])
    h = w * height / F.greatest(F.lit(1), width) * ASPECT
    low = tallest * 0.9
    return F.struct(F.when(h > low, low / ASPECT * width / F.greatest(F.lit(1), height)).otherwise(w).alias("w"), F.least(h, low).alias("h"))


def note_tops(notes: DataFrame, key: str = "page") -> DataFrame:
    """notes (key, no, y, h) with ``top``: stacked beside the text, each at its anchor or below the one before, half a gap apart."""
    w = Window.partitionBy(key).orderBy("no")
    d = notes.withColumn("__c", F.coalesce(F.sum(F.col("h") + GAP / 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return d.withColumn("top", F.col("__c") + F.max(F.col("y") - F.col("__c")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def clean_measures(measures: DataFrame) -> DataFrame:
    """measures (h, lh, lines) clamped: heights 0 to 10, line heights from 0.001, at most 5000 lines; entries without a height go."""
    d = measures.where("h IS NOT NULL").withColumn("h", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("h"))))
    return d.withColumn("lh", F.greatest(F.lit(0.001), F.least(F.lit(10.0), F.col("lh")))).withColumn("lines", F.slice("lines", 1, 5000))


def adopted_blocks(flowmap: DataFrame, adopted: DataFrame, staged: DataFrame) -> DataFrame:
    """(sourceid, block_index) on adopted pages and on no page that is still staged; flowmap (sourceid, pageid, block_index)."""
    on = lambda pages: flowmap.join(pages.select(F.col("id").alias("pageid")).distinct(), "pageid", "left_semi").select("sourceid", "block_index").distinct()
    return on(adopted).join(on(staged), ["sourceid", "block_index"], "left_anti")


# Lines that an element takes besides its text.
AROUND = {"heading": 0.8, "list": 0.6, "row": 0.4, "table": 0.8, "pre": 1.6, "text": 0.6}


def html_height(tag: Column, html: Column, width: Column | float) -> Column:
    """Estimated height of a text element in page units, from its markup: by items for lists, by the tallest cell of each row for tables, by line ends for pre.

    The same estimate that the setting of pages takes; entities beside the six common ones count as they are written.
    """
    w = F.lit(width) if isinstance(width, float) else width
    n = G.chars_per_line(w, F.lit(1.0))
    size = lambda x: F.length(T.bare_text(x))
    each = lambda rx, x: F.regexp_extract_all(x, F.lit(rx), F.lit(0))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    items = each(r"(?s)<(li|dt|dd)\b.*?</\1>", html)
    listed = total(F.when(F.size(items) > 0, items).otherwise(F.array(html)), lambda x: F.greatest(F.lit(1.0), F.ceil(size(x) / F.greatest(F.lit(10), n - 4)).cast("double")))

    def row(x: Column) -> Column:
        cells = each(r"(?s)<t[dh]\b.*?</t[dh]>", x)
        room = F.greatest(F.lit(4.0), n / F.greatest(F.lit(1), F.size(cells)) - 2)
        return F.aggregate(cells, F.lit(1.0), lambda acc, c: F.greatest(acc, F.ceil(size(c) / room).cast("double"))) + AROUND["row"]

    lines = F.greatest(F.lit(1.0), F.ceil(size(html) / n).cast("double")) + AROUND["text"]
    lines = F.when(tag.isin("ul", "ol", "dl"), listed + AROUND["list"]).when(tag == "table", total(each(r"(?s)<tr\b.*?</tr>", html), row) + AROUND["table"]).when(tag == "pre", F.size(F.split(F.regexp_replace(html, "<[^>]*>", ""), "\n", -1)) - 1 + AROUND["pre"]).otherwise(lines)
    for h, scale in G.HEADINGS.items():
        lines = F.when(tag == h, F.ceil(size(html) / G.chars_per_line(w, F.lit(scale))) * scale + AROUND["heading"]).otherwise(lines)
    return lines * LINE_H * 1.05
