"""Published excerpts, print sheets and print plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import PAGE_H, PAGE_W, SLOTS, fit_page, side
from quire.functions.ranges import in_range
from quire.operators.order import reading_order
from quire.operators.overlay import FRAMES
from quire.operators.provenance import printed_citation

PER_SIDE = {"1up": 1, "2up": 2, "4up": 4, "booklet": 2}


def _in_document(by: str) -> Window:
    return Window.partitionBy("documentid").orderBy(by)


def published_pages(pages: DataFrame, documents: DataFrame, rng: str = "pagerange") -> DataFrame:
    """Pages of each document's published range, with their original ``pagenumber``."""
    firsts = documents.select(F.col("id").alias("documentid"), F.col(rng).alias("__r"), "firstpageright")
    d = reading_order(pages).withColumn("__t", F.count("*").over(Window.partitionBy("documentid"))).join(firsts, "documentid")
    return d.where(in_range(F.col("__r"), F.col("position"), F.col("__t"))).drop("__r", "__t").withColumnRenamed("position", "pagenumber")


def print_selection(published: DataFrame, expr: str) -> DataFrame:
    """Of published pages, renumbered from 1, those of a further range; ``position`` is their place in print."""
    w = _in_document("pagenumber")
    d = published.withColumn("__n", F.row_number().over(w).cast("long")).withColumn("__t", F.count("*").over(Window.partitionBy("documentid")))
    return d.where(in_range(F.lit(expr), F.col("__n"), F.col("__t"))).withColumn("position", F.row_number().over(w).cast("long")).drop("__n", "__t")


def slot_of(layout: str, position: Column, count: Column, startright: Column) -> tuple[Column, Column]:
    """(side number, slot number), both from 0, of a page in print."""
    if layout == "booklet":
        p, c = F.when(startright, position).otherwise(position + 1), F.when(startright, count).otherwise(count + 1)
        n = 4 * F.ceil(c / 4)
        q = F.least(p, n + 1 - p)
        low, front = p == q, q % 2 == 1
        return (q - 1).cast("long"), F.when(front, F.when(low, 1).otherwise(0)).otherwise(F.when(low, 0).otherwise(1)).cast("long")
    slots = PER_SIDE[layout]
    z = position - 1 + (F.when(startright, 1).otherwise(0) if slots > 1 else F.lit(0))
    return F.floor(z / slots).cast("long"), (z % slots).cast("long")


def impose(printed: DataFrame, layout: str) -> DataFrame:
    """printed (documentid, position, startright) -> (documentid, side_no, slot_no, position): every slot of every side, empty ones null."""
    counts = printed.groupBy("documentid").agg(F.count("*").alias("c"), F.first("startright").alias("startright"))
    c1 = F.when(F.col("startright"), F.col("c")).otherwise(F.col("c") + 1)
    slots = PER_SIDE[layout]
    sides = 2 * F.ceil(c1 / 4) if layout == "booklet" else F.ceil((F.col("c") + (F.when(F.col("startright"), 1).otherwise(0) if slots > 1 else F.lit(0))) / slots)
    grid = counts.select("documentid", F.explode(F.sequence(F.lit(0).cast("long"), sides.cast("long") - 1)).alias("side_no"))
    grid = grid.select("documentid", "side_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot_no"))
    at, slot = slot_of(layout, F.col("position"), F.col("c"), F.col("startright"))
    placed = printed.select("documentid", "position").join(counts, "documentid").select("documentid", at.alias("side_no"), slot.alias("slot_no"), "position")
    return grid.join(placed, ["documentid", "side_no", "slot_no"], "left")


def slot_boxes(layout: str) -> Column:
    """Array of the boxes of a layout's slots, in mm."""
    return F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", box)]) for box in SLOTS[layout]])


def print_plan(pages: DataFrame, documents: DataFrame, layout: str = "booklet", expr: str = "") -> DataFrame:
    """(documentid, side_no, slot_no, id, pagenumber, x, y, w, h): where on the sheets each published page is drawn, in mm."""
    printed = print_selection(published_pages(pages, documents), expr)
    starts = F.first(side(F.col("pagenumber"), F.col("firstpageright")) == "right").over(_in_document("position"))
    count = F.count("*").over(Window.partitionBy("documentid"))
    printed = printed.withColumns({"__s": starts, "__c": count})
    at, slot = slot_of(layout, F.col("position"), F.col("__c"), F.col("__s"))
    place = slot_boxes(layout)[slot.cast("int")]
    if layout == "1up":  # the sheet lies as its page does
        across = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", (0, 0, PAGE_H, PAGE_W))])
        place = F.when(F.col("width") > F.col("height"), across).otherwise(place)
    box = fit_page(place, F.col("width"), F.col("height"))
    d = printed.withColumns({"side_no": at, "slot_no": slot, "box": box})
    return d.select("documentid", "side_no", "slot_no", "id", "pagenumber", *[F.round(F.col("box")[k], 4).alias(k) for k in "xywh"])


DRAWN = (*FRAMES, "mask", "textbox")


def print_items(pages: DataFrame, documents: DataFrame, overlays: DataFrame, sources: DataFrame, layout: str = "booklet", expr: str = "", solutions: bool = False) -> DataFrame:
    """(documentid, side_no, slot_no, pageid, z, kind, overlayid, x, y, w, h, text): everything that is drawn on the sheets, in mm, z from below.

    For each printed page: the page (its citation takes 4 mm below it, if it has one), its frames, then its masks (not with
    ``solutions``) and text boxes in their order, and the citation with its text. Pages without a size count as upright.
    """
    printed = print_selection(published_pages(pages, documents), expr)
    starts = F.first(side(F.col("pagenumber"), F.col("firstpageright")) == "right").over(_in_document("position"))
    printed = printed.withColumns({"__s": starts, "__c": F.count("*").over(Window.partitionBy("documentid"))})
    at, slot = slot_of(layout, F.col("position"), F.col("__c"), F.col("__s"))
    place = slot_boxes(layout)[slot.cast("int")]
    if layout == "1up":
        across = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", (0, 0, PAGE_H, PAGE_W))])
        place = F.when(F.col("width") > F.col("height"), across).otherwise(place)
    cited = sources.select(F.col("id").alias("sourceid"), printed_citation().alias("__text"))
    d = printed.withColumns({"side_no": at, "slot_no": slot, "__p": place}).join(cited, "sourceid", "left").withColumn("__text", F.coalesce("__text", F.lit("")))
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    width, height = F.when(sized, F.col("width")).otherwise(PAGE_W), F.when(sized, F.col("height")).otherwise(PAGE_H)
    box = F.when(F.col("__text") == "", fit_page(F.col("__p"), width, height, footer=0.0)).otherwise(fit_page(F.col("__p"), width, height))
    d = d.withColumn("__b", box).select("documentid", "side_no", "slot_no", F.col("id").alias("pageid"), "__p", "__b", "__text")
    shown = overlays.where(F.col("overlaytype").isin(*DRAWN) & (~F.lit(solutions) | (F.col("overlaytype") != "mask")))
    order = Window.partitionBy("pageid").orderBy((~F.col("overlaytype").isin(*FRAMES)).cast("int"), "sortorder", "id")
    shown = shown.withColumn("__z", F.row_number().over(order)).select("pageid", F.col("id").alias("__o"), F.col("overlaytype").alias("__kind"), "__z", *[F.col(c).cast("double").alias(f"__{c}") for c in "xywh"])
    item = lambda z, kind, overlay, x, y, w, h, text: F.struct(z.alias("z"), kind.alias("kind"), overlay.alias("overlayid"), *[c.cast("double").alias(k) for c, k in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))], text.alias("text"))
    b, p, none = F.col("__b"), F.col("__p"), F.lit(None)
    page = item(F.lit(0), F.lit("page"), none.cast("long"), b["x"], b["y"], b["w"], b["h"], none.cast("string"))
    note = item(F.lit(1 << 30), F.lit("citation"), none.cast("long"), p["x"] + 5, p["y"] + p["h"] - 9, p["w"] - 10, F.lit(4.0), F.col("__text"))
    over = item(F.col("__z"), F.col("__kind"), F.col("__o"), b["x"] + F.col("__x") * b["w"], b["y"] + F.col("__y") * b["h"], F.col("__w") * b["w"], F.col("__h") * b["h"], none.cast("string"))
    first = F.coalesce(F.col("__z") == 1, F.lit(True))  # a page's own items go with its first overlay, or stand alone
    items = F.filter(F.array(F.when(first, page), F.when(F.col("__z").isNotNull(), over), F.when(first & (F.col("__text") != ""), note)), lambda i: i.isNotNull())
    drawn = d.join(shown, "pageid", "left").select("documentid", "side_no", "slot_no", "pageid", F.explode(items).alias("__i"))
    return drawn.select("documentid", "side_no", "slot_no", "pageid", "__i.*")
