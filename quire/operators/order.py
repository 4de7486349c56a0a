"""Order and sides of pages: balancing, spreads, moves. One document is one window partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import mirrored, required_side, side
from quire.functions.keys import looked_up


def by():
    """A document's pages in order."""
    return Window.partitionBy("documentid").orderBy("sortorder", "id")


def reading_order(pages: DataFrame, staged: bool = False) -> DataFrame:
    """Pages of the documents (or of the import area) with their 1-based position."""
    return pages.where(F.col("staged") == staged).withColumn("position", F.row_number().over(by()).cast("long"))


def import_area(pages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Pages of the import area in order, with ``position`` in their document's area; only those of sources (id) if given, numbered among these."""
    d = pages if sources is None else pages.join(sources.select(F.col("id").alias("sourceid")).distinct(), "sourceid", "left_semi").select(*pages.columns)
    return reading_order(d, True)


def kept_pages(pages: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """Pages that stay when blanks are dealt anew: all but unused canvas fillers."""
    unused = F.col("filler") & (F.col("pagetype") == "canvas")
    if overlays is None:
        return pages.where(~unused)
    used = overlays.select(F.col("pageid").alias("id")).distinct().withColumn("__used", F.lit(True))
    return pages.join(used, "id", "left").where(~(unused & F.col("__used").isNull())).drop("__used")


def rebalance(pages: DataFrame, documents: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """Kept pages with ``position``, ``side`` and ``blank_before``: a blank goes before a page whose required side is the other one.

    Blanks are found without a loop: with k the running number of a page, the last page before it
    that requires a side fixes the parity that page k would have by itself.
    """
    firsts = documents.select(F.col("id").alias("documentid"), "firstpageright")
    return with_blanks(kept_pages(pages, overlays).where("NOT staged").join(firsts, "documentid"), "documentid")


def with_blanks(d: DataFrame, *keys: str, order: tuple[str, ...] = ("sortorder", "id")) -> DataFrame:
    """d (firstpageright, spreadside, pinside) with ``required``, ``blank_before``, ``position`` and ``side`` within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumn("k", F.row_number().over(w).cast("long")).withColumn("required", required_side(F.col("spreadside"), F.col("pinside")))
    d = d.withColumn("par", F.when(F.col("required").isNotNull(), F.when((F.col("required") == "right") == F.col("firstpageright"), 1).otherwise(0)).cast("long"))
    d = d.withColumn("v", F.max(2 * F.col("k") + F.col("par")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    natural = F.when(F.col("v").isNull(), F.col("k") % 2).otherwise((F.col("v") % 2 + F.col("k") - F.floor(F.col("v") / 2)) % 2)
    d = d.withColumn("blank_before", F.coalesce(natural != F.col("par"), F.lit(False)))
    d = d.withColumn("position", F.col("k") + F.sum(F.col("blank_before").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("side", side(F.col("position"), F.col("firstpageright"))).drop("v", "par", "k")


def starts(pages: DataFrame, documents: DataFrame, startright: bool) -> DataFrame:
    """(documentid, firstpageright, position, shifted): where pages flowed next begin; with startright a blank goes first if that is a left page."""
    n = pages.groupBy("documentid").agg(F.count_if(~F.col("staged")).alias("n"))
    d = documents.select(F.col("id").alias("documentid"), "firstpageright").join(n, "documentid", "left")
    d = d.withColumn("position", F.coalesce("n", F.lit(0)) + 1)
    shifted = F.lit(startright) & (side(F.col("position"), F.col("firstpageright")) != "right")
    return d.select("documentid", "firstpageright", (F.col("position") + shifted.cast("long")).alias("position"), shifted.alias("shifted"))


def import_preview(pages: DataFrame, documents: DataFrame, startright: bool = False) -> DataFrame:
    """(documentid, sourceid, id, position, side, filler, row_no, chained, ghost): each source's staged pages as they would follow the document.

    Blanks (id null) keep required sides; a left page and the right page behind it share a row unless
    one is landscape; ``ghost`` is the empty side beside a single page.
    """
    base = starts(pages, documents, startright).withColumnsRenamed({"position": "__base", "firstpageright": "__first"}).drop("shifted")
    d = pages.where("staged").join(base, "documentid").withColumn("firstpageright", F.col("__first") == (F.col("__base") % 2 == 1))
    d = with_blanks(d, "documentid", "sourceid").withColumn("position", F.col("position") + F.col("__base") - 1)
    blank = F.struct(F.lit(None).cast("long").alias("id"), (F.col("position") - 1).alias("position"), F.lit(True).alias("filler"), F.lit(False).alias("wide"), F.lit(None).cast("string").alias("half"))
    page = F.struct(F.col("id").cast("long").alias("id"), F.col("position").alias("position"), F.lit(False).alias("filler"), F.col("landscapelock").alias("wide"), F.when(F.col("spreadid").isNotNull(), F.col("spreadside")).alias("half"))
    items = d.select("documentid", "sourceid", "__first", F.explode(F.when(F.col("blank_before"), F.array(blank, page)).otherwise(F.array(page))).alias("i")).select("documentid", "sourceid", "__first", "i.*")
    items = items.withColumn("side", side(F.col("position"), F.col("__first")))
    w = Window.partitionBy("documentid", "sourceid").orderBy("position")
    joins = F.coalesce((F.col("side") == "right") & ~F.col("wide") & (F.lag("side").over(w) == "left") & ~F.lag("wide").over(w), F.lit(False))
    items = items.withColumn("__joins", joins).withColumn("__joined", F.coalesce(F.lead("__joins").over(w), F.lit(False)))
    items = items.withColumn("row_no", F.count_if(~F.col("__joins")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chained = F.col("__joins") & F.coalesce((F.lag("half").over(w) == "left") & (F.col("half") == "right"), F.lit(False))
    alone = ~F.col("__joins") & ~F.col("__joined") & ~F.col("wide")
    ghost = F.when(alone, F.when(F.col("side") == "right", "left").otherwise("right"))
    return items.select("documentid", "sourceid", "id", "position", "side", "filler", "row_no", chained.alias("chained"), ghost.alias("ghost"))


def insert_blanks(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """(documentid, id, position) with a new blank (id null) for each command (documentid, id, before): never inside a spread.

    Before or after a page of a spread means before its left or after its right half. Commands of
    pages that aren't there, or are staged, do nothing; of equal ones the page gets as many blanks.
    """
    d = reading_order(pages)
    spread = Window.partitionBy("documentid", F.coalesce(F.col("spreadid"), -F.col("id")))
    at = lambda s: F.coalesce(F.max(F.when(F.col("spreadid").isNotNull() & (F.col("spreadside") == s), F.col("position"))).over(spread), F.col("position"))
    d = d.withColumns({"__l": at("left"), "__r": at("right")})
    new = d.join(commands.select("documentid", "id", "before"), ["documentid", "id"]).select("documentid", F.lit(None).cast("long").alias("id"), F.when(F.col("before"), 2 * F.col("__l") - 1).otherwise(2 * F.col("__r") + 1).alias("__p"))
    both = d.select("documentid", F.col("id").cast("long").alias("id"), (2 * F.col("position")).alias("__p")).unionByName(new)
    return both.select("documentid", "id", F.row_number().over(Window.partitionBy("documentid").orderBy("__p")).cast("long").alias("position"))


def balanced_pages(pages: DataFrame, documents: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """(documentid, position, id, filler): kept pages and blanks; the i-th blank takes the i-th unused filler, the rest have no id."""
    d = rebalance(pages, documents, overlays)
    blanks = d.where("blank_before").select("documentid", (F.col("position") - 1).alias("position"))
    blanks = blanks.withColumn("i", F.row_number().over(Window.partitionBy("documentid").orderBy("position")))
    pool = pages.where("NOT staged AND filler AND pagetype = 'canvas'")
    if overlays is not None:
        pool = pool.join(overlays.select(F.col("pageid").alias("id")), "id", "left_anti")
    pool = pool.select("documentid", "id", F.row_number().over(by()).alias("i"))
    filled = blanks.join(pool, ["documentid", "i"], "left").select("documentid", "position", "id", F.lit(True).alias("filler"))
    return d.select("documentid", "position", "id", F.lit(False).alias("filler")).unionByName(filled)


def spreads(placed: DataFrame) -> DataFrame:
    """placed (documentid, position, side, width, height) with ``row_no``: a right page joins the left page just before it."""
    w = Window.partitionBy("documentid").orderBy("position")
    wide = F.col("width") > F.col("height")
    joins = (F.col("side") == "right") & ~wide & (F.lag("side").over(w) == "left") & ~F.lag(wide).over(w) & (F.lag("position").over(w) == F.col("position") - 1)
    d = placed.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return d.withColumn("row_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def layout_issues(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(documentid, id, position, torn, wrong_side) of pages with an issue, as the pages lie now.

    A spread is torn where its left half isn't followed by a page of the same spread; the right half
    is not reported as torn.
    """
    firsts = documents.select(F.col("id").alias("documentid"), "firstpageright")
    d = reading_order(pages).join(firsts, "documentid").withColumn("side", side(F.col("position"), F.col("firstpageright")))
    w = Window.partitionBy("documentid").orderBy("position")
    torn = F.col("spreadid").isNotNull() & F.coalesce(F.col("spreadside") == "left", F.lit(False)) & ~F.coalesce(F.lead("spreadid").over(w) == F.col("spreadid"), F.lit(False))
    wrong = F.coalesce(required_side(F.col("spreadside"), F.col("pinside")) != F.col("side"), F.lit(False))
    return d.select("documentid", "id", "position", torn.alias("torn"), wrong.alias("wrong_side")).where("torn OR wrong_side")


def can_link(pages: DataFrame) -> DataFrame:
    """(documentid, id, next_id): ordinary pages that are in no spread, followed by another such page."""
    d = pages.where("NOT staged AND NOT filler")
    nxt = d.withColumn("next_id", F.lead("id").over(by())).withColumn("next_spread", F.lead("spreadid").over(by()))
    return nxt.where("spreadid IS NULL AND next_spread IS NULL AND next_id IS NOT NULL").select("documentid", "id", "next_id")


def link_spreads(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """pages after commands (id): each named page and the next one of its set become a spread, their pins go.

    The set is the document, or in the import area the pages of the same source, without fillers. A
    page that is in a spread, or whose successor is, is left alone. Of consecutive named pages the
    first goes with the second, the third with the fourth and so on, as one command after the other
    in reading order would have it.
    """
    named = commands.select("id").distinct().withColumn("__go", F.lit(True))
    d = pages.join(named, "id", "left").withColumn("__set", F.when(F.col("staged"), F.coalesce("sourceid", F.lit(-1))))
    keys = ("documentid", "staged", "__set", "filler")
    w = Window.partitionBy(*keys).orderBy("sortorder", "id")
    ok = F.col("__go") & ~F.col("filler") & F.col("spreadid").isNull() & F.lead("id").over(w).isNotNull() & F.lead("spreadid").over(w).isNull()
    d = d.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    d = d.withColumn("__run", F.count_if(~F.col("__ok")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__k", F.count_if("__ok").over(Window.partitionBy(*keys, "__run").orderBy("sortorder", "id").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__left", F.col("__ok") & (F.col("__k") % 2 == 1))
    d = d.withColumn("__right", F.coalesce(F.lag("__left").over(w), F.lit(False))).withColumn("__first", F.lag("id").over(w))
    new = F.when(F.col("__left"), F.col("id")).when(F.col("__right"), F.col("__first")).otherwise(F.col("spreadid"))
    at = F.when(F.col("__left"), "left").when(F.col("__right"), "right").otherwise(F.col("spreadside"))
    pin = F.when(~(F.col("__left") | F.col("__right")), F.col("pinside"))
    return d.withColumns({"spreadid": new, "spreadside": at, "pinside": pin}).select(*pages.columns)


def unlink(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """pages after all pages of the spreads named by commands (spreadid) left them."""
    named = commands.select("spreadid").distinct().withColumn("__go", F.lit(True))
    d = looked_up(pages, "spreadid", named)
    gone = F.col("__go").isNotNull()
    return d.withColumns({"spreadid": F.when(~gone, F.col("spreadid")), "spreadside": F.when(~gone, F.col("spreadside"))}).select(*pages.columns)


def set_pins(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """pages after commands (id, pin); pages of a spread keep no pin, other values clear it."""
    d = pages.join(commands.select("id", "pin").withColumn("__go", F.lit(True)), "id", "left")
    pin = F.when(F.col("__go") & F.col("spreadid").isNull(), F.when(F.col("pin").isin("left", "right"), F.col("pin"))).otherwise(F.when(F.col("__go").isNull(), F.col("pinside")))
    return d.withColumn("pinside", pin).select(*pages.columns)


def mirror_changed(overlays: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """overlays with x mirrored on pages whose set side (pages.layoutside) isn't their side now."""
    firsts = documents.select(F.col("id").alias("documentid"), "firstpageright")
    d = reading_order(pages).join(firsts, "documentid")
    turned = d.where(F.col("layoutside").isNotNull() & (F.col("layoutside") != side(F.col("position"), F.col("firstpageright")))).select(F.col("id").alias("pageid"), F.lit(True).alias("__t"))
    return overlays.join(turned, "pageid", "left").withColumn("x", F.when(F.col("__t"), mirrored(F.col("x"), F.col("w"))).otherwise(F.col("x"))).select(*overlays.columns)


def move_units(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """(documentid, id, position) after commands (documentid, id, up): the page, with its spread, changes places with its neighbour.

    Unused fillers are dropped first; one command per document; at an end nothing moves.
    """
    d = kept_pages(pages).where("NOT staged")
    unit = F.min(F.struct("sortorder", "id")).over(Window.partitionBy("documentid", F.coalesce(F.col("spreadid"), -F.col("id"))))
    d = d.withColumn("__u", unit).withColumn("rank", F.dense_rank().over(Window.partitionBy("documentid").orderBy("__u")))
    chosen = d.join(commands.select("documentid", "id", "up"), ["documentid", "id"]).select("documentid", F.col("rank").alias("__from"), F.when(F.col("up"), F.col("rank") - 1).otherwise(F.col("rank") + 1).alias("__to"))
    last = d.groupBy("documentid").agg(F.max("rank").alias("__last"))
    chosen = chosen.join(last, "documentid").where("__to between 1 and __last")
    d = d.join(chosen, "documentid", "left")
    rank = F.when(F.col("rank") == F.col("__from"), F.col("__to")).when(F.col("rank") == F.col("__to"), F.col("__from")).otherwise(F.col("rank"))
    w = Window.partitionBy("documentid").orderBy("__rank", "sortorder", "id")
    return d.withColumn("__rank", rank).select("documentid", "id", F.row_number().over(w).cast("long").alias("position"))


def splice(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """(documentid, id, position): staged pages named by commands (documentid, id, anchor) go behind the anchor page, in their own order.

    anchor 0 is the start; null or a page that isn't there is the end.
    """
    here = reading_order(pages).select("documentid", "id", F.col("position").alias("__a"), F.lit(0).alias("__b"), "sortorder")
    places = here.select("documentid", F.col("id").alias("anchor"), F.col("__a").alias("__p"))
    new = pages.where("staged").select("documentid", "id", "sortorder").join(commands.select("documentid", "id", "anchor"), ["documentid", "id"]).join(places, ["documentid", "anchor"], "left")
    at = F.when(F.col("anchor") == 0, F.lit(0)).otherwise(F.coalesce("__p", F.lit(2**31))).cast("long")
    new = new.select("documentid", "id", at.alias("__a"), F.lit(1).alias("__b"), "sortorder")
    w = Window.partitionBy("documentid").orderBy("__a", "__b", "sortorder", "id")
    return here.withColumn("__a", F.col("__a").cast("long")).unionByName(new).select("documentid", "id", F.row_number().over(w).cast("long").alias("position"))
