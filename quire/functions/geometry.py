"""Sides, type areas and boxes of pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millimetres of a page, its margins and note column; millimetres of text lines.
PAGE_W, PAGE_H = 210, 297
TOP, BOTTOM, INNER, OUTER = 20, 25, 25, 18
NOTES_INNER, NOTES_OUTER, NOTE_GAP, NOTE_EDGE = 20, 68, 7, 12
CANVAS = (1240, 1754)
FONT, LINE, CHAR, SERIF, GAP = 3.88, 1.4, 0.5, 0.42, 4.0
HEADINGS = {"h1": 1.8, "h2": 1.5, "h3": 1.3, "h4": 1.15, "h5": 1.05, "h6": 1.0}
NOTE_SCALE, MARGIN_FIGURE = 0.8, 450
SLOTS = {  # layout: x, y, w, h of each slot on its sheet
    "1up": ((0, 0, 210, 297),),
    "2up": ((0, 0, 148.5, 210), (148.5, 0, 148.5, 210)),
    "booklet": ((0, 0, 148.5, 210), (148.5, 0, 148.5, 210)),
    "4up": ((0, 0, 105, 148.5), (105, 0, 105, 148.5), (0, 148.5, 105, 148.5), (105, 148.5, 105, 148.5)),
}


def side(position: Column, firstright: Column) -> Column:
    """right or left of a 1-based position."""
    return F.when((position % 2 == 1) == firstright, "right").otherwise("left")


def required_side(spreadside: Column, pinside: Column) -> Column:
    """The spread's side, else a valid pin, else null."""
    valid = lambda c: F.when(c.isin("left", "right"), c)
    return F.coalesce(valid(spreadside), valid(pinside))


def type_area(side_: Column, notes: Column) -> Column:
    """Box (x, y, w, h) of the text in page units; ``notes`` chooses the style with a note column."""
    inner = F.when(notes, NOTES_INNER).otherwise(INNER)
    outer = F.when(notes, NOTES_OUTER).otherwise(OUTER)
    x = F.when(side_ == "right", inner).otherwise(outer) / F.lit(float(PAGE_W))
    return F.struct(x.alias("x"), F.lit(TOP / PAGE_H).alias("y"), ((PAGE_W - inner - outer) / F.lit(float(PAGE_W))).alias("w"), F.lit((PAGE_H - TOP - BOTTOM) / PAGE_H).alias("h"))


def note_area(side_: Column) -> Column:
    """Box of the note column on the outer side."""
    width = (NOTES_OUTER - NOTE_GAP - NOTE_EDGE) / PAGE_W
    x = F.when(side_ == "right", F.lit((PAGE_W - NOTES_OUTER + NOTE_GAP) / PAGE_W)).otherwise(F.lit(NOTE_EDGE / PAGE_W))
    return F.struct(x.alias("x"), F.lit(TOP / PAGE_H).alias("y"), F.lit(width).alias("w"), F.lit((PAGE_H - TOP - BOTTOM) / PAGE_H).alias("h"))


def clamp_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box cut to the unit square; decimals stay decimals."""
    zero, one = F.lit(0).cast("decimal(10,6)"), F.lit(1).cast("decimal(10,6)")
    cx, cy = F.greatest(zero, F.least(one, x)), F.greatest(zero, F.least(one, y))
    d = "decimal(10,6)"
    return F.struct(cx.cast(d).alias("x"), cy.cast(d).alias("y"), F.greatest(zero, F.least(w, one - cx)).cast(d).alias("w"), F.greatest(zero, F.least(h, one - cy)).cast(d).alias("h"))


def mirrored(x: Column, w: Column) -> Column:
    """x of a box on the facing side."""
    return F.greatest(F.lit(0), 1 - x - w).cast("decimal(10,6)")


def clip_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixels of a region, one at least."""
    return F.struct(F.round(x * width).cast("int").alias("left"), F.round(y * height).cast("int").alias("top"), F.greatest(F.lit(1), F.round(w * width)).cast("int").alias("width"), F.greatest(F.lit(1), F.round(h * height)).cast("int").alias("height"))


def fit_page(slot: Column, width: Column, height: Column, margin: float = 5.0, footer: float = 4.0) -> Column:
    """Centred box of a page in a slot, with a margin and room for the citation line."""
    w, h = slot["w"] - 2 * margin, slot["h"] - 2 * margin - footer
    scale = F.least(w / width, h / height)
    pw, ph = width * scale, height * scale
    return F.struct((slot["x"] + margin + (w - pw) / 2).alias("x"), (slot["y"] + margin + (h - ph) / 2).alias("y"), pw.alias("w"), ph.alias("h"))


def fit_image(w: Column, h: Column, iw: Column, ih: Column, cover: Column) -> Column:
    """contain: centred box inside (w, h); cover: centred crop of the image in its own pixels."""
    s = F.least(w / iw, h / ih)
    c = F.greatest(w / iw, h / ih)
    return F.when(cover, F.struct(((iw - w / c) / 2).alias("x"), ((ih - h / c) / 2).alias("y"), (w / c).alias("w"), (h / c).alias("h"))).otherwise(F.struct(((w - iw * s) / 2).alias("x"), ((h - ih * s) / 2).alias("y"), (iw * s).alias("w"), (ih * s).alias("h")))


def line_height(scale: float | Column = 1.0) -> Column:
    """Height of a line in page units."""
    return F.lit(FONT * LINE / PAGE_H) * scale


def chars_per_line(width: Column, scale: float | Column = 1.0) -> Column:
    """Characters on a line of a width in page units, ten at least."""
    return F.greatest(F.lit(10), F.floor(width * PAGE_W / (FONT * CHAR * F.lit(scale) if not isinstance(scale, Column) else FONT * CHAR * scale))).cast("int")
