"""Page edits with all that follows from them: the new order, blanks that keep required sides, mirrored frames.

Commands come at most one for a document and call. Pages, documents and commands are shuffled by
document once; lookups inside a document (the anchor, the neighbour, the filler that a blank takes)
are windows over that partitioning, never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import mirrored
from quire.functions.tables import small_tasks
from quire.operators.order import with_blanks

OUT = ("documentid", "id", "position", "side", "filler", "spreadid", "spreadside", "pinside", "layoutside", "turned")


def _with(pages: DataFrame, documents: DataFrame, commands: DataFrame | None, used: DataFrame | None) -> DataFrame:
    """pages with firstpageright, the fields of their document's command (prefix c_) and whether they are unused fillers."""
    d = pages.join(documents.select(F.col("id").alias("documentid"), "firstpageright"), "documentid")
    if commands is not None:
        d = d.join(commands.select("documentid", *[F.col(c).alias(f"c_{c}") for c in commands.columns if c != "documentid"]), "documentid", "left")
    unused = F.col("filler") & (F.col("pagetype") == "canvas")
    if used is not None:
        d = d.join(used.select(F.col("pageid").alias("id")).distinct().withColumn("__used", F.lit(True)), "id", "left")
        unused = unused & F.col("__used").isNull()
    if "layoutside" not in d.columns:
        d = d.withColumn("layoutside", F.lit(None).cast("string"))
    return d.withColumn("__unused", F.coalesce(unused, F.lit(False)))


def _whole(c: Column) -> Column:
    """The largest value of c in a page's document."""
    return F.max(c).over(Window.partitionBy("documentid"))


def settled(d: DataFrame, *order: str) -> DataFrame:
    """Rows (page columns, firstpageright, __unused) in an order -> (documentid, id, position, side, filler, spreadid, spreadside, pinside, layoutside, turned).

    A blank stands before each page that would lie on the wrong side; the i-th takes the i-th unused filler of its document,
    further ones have no id yet, surplus fillers go. ``turned`` marks pages that were set for the other side: their frames are
    to be mirrored, layoutside is the new side.
    """
    small_tasks(d.sparkSession)  # a page is in as many sorts as there are windows
    d = d.withColumns({c: F.when(~F.col("__unused"), F.col(c)) for c in ("spreadside", "pinside")})
    d = with_blanks(d, "documentid", "__unused", order=order)
    w = Window.partitionBy("documentid", "__unused").orderBy("position")
    d = d.withColumn("__i", F.sum(F.col("blank_before").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    none = lambda c: F.lit(None).cast(d.schema[c].dataType)
    item = lambda kind, i, position, page: F.struct(F.lit(kind).alias("kind"), i.alias("i"), position.alias("position"), *[(F.col(c) if page else none(c)).alias(c) for c in ("id", "spreadid", "spreadside", "pinside", "layoutside")])
    page = item(0, F.lit(None).cast("long"), F.col("position"), True)
    blank = item(1, F.col("__i"), F.col("position") - 1, False)
    filler = item(2, F.col("position"), F.lit(None).cast("long"), True)
    d = d.select("documentid", "firstpageright", F.coalesce("filler", F.lit(False)).alias("filler"), F.explode(F.when(F.col("__unused"), F.array(filler)).when(F.col("blank_before"), F.array(blank, page)).otherwise(F.array(page))).alias("x")).select("documentid", "firstpageright", "filler", "x.*")
    taken = F.max(F.when(F.col("kind") == 2, F.col("id"))).over(Window.partitionBy("documentid", "i"))
    d = d.withColumn("id", F.when(F.col("kind") == 1, taken).otherwise(F.col("id"))).where("kind < 2")
    side = F.when((F.col("position") % 2 == 1) == F.col("firstpageright"), "right").otherwise("left")
    d = d.withColumn("side", side).withColumn("filler", (F.col("kind") == 1) | F.col("filler"))
    turned = F.coalesce(F.col("layoutside") != F.col("side"), F.lit(False))
    return d.withColumn("turned", turned).withColumn("layoutside", F.when(F.col("layoutside").isNotNull(), F.col("side"))).select(*OUT)


def arranged(pages: DataFrame, documents: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Pages of documents (not of the import area) as they are, balanced anew. used (pageid): pages with overlays, whose fillers stay."""
    return settled(_with(pages.where("NOT staged"), documents, None, used), "sortorder", "id")


def adopt(pages: DataFrame, documents: DataFrame, commands: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Documents after commands (documentid, id, anchor), one row for each staged page that is taken over.

    The pages go behind the anchor in their own order; 0 is the start, null or a page that isn't there the
    end (of several anchors of a document the largest). Spreads that are torn by this are dissolved. Commands
    of pages that aren't staged do nothing.
    """
    named = commands.groupBy("documentid").agg(F.collect_set("id").alias("ids"), F.max("anchor").alias("anchor"))
    d = _with(pages, documents, named, used)
    d = d.withColumn("__taken", F.col("staged") & F.coalesce(F.array_contains("c_ids", F.col("id")), F.lit(False)))
    spread = Window.partitionBy("documentid", "spreadid")
    torn = F.col("spreadid").isNotNull() & (F.count_if("__taken").over(spread) > 0) & (F.count_if(F.col("staged") & ~F.col("__taken")).over(spread) > 0)
    d = d.withColumn("__torn", torn).withColumns({c: F.when(~F.col("__torn"), F.col(c)) for c in ("spreadid", "spreadside")}).where("NOT staged OR __taken")
    d = d.withColumn("__at", F.row_number().over(Window.partitionBy("documentid", "__taken").orderBy("sortorder", "id")).cast("long"))
    anchor = _whole(F.when(~F.col("__taken") & (F.col("id") == F.col("c_anchor")), F.col("__at")))
    d = d.withColumn("__anchor", anchor)
    d = d.withColumn("__a", F.when(~F.col("__taken"), F.col("__at")).when(F.col("c_anchor") == 0, 0).otherwise(F.coalesce("__anchor", F.lit(1 << 62))))
    return settled(d, "__a", "__taken", "sortorder", "id")


def insert(pages: DataFrame, documents: DataFrame, commands: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Documents after commands (documentid, id, before), one for each document: an empty page without an id yet stands before or after the page.

    Spreads stay whole: before their left or after their right half. It is an ordinary page, no filler. Commands of pages that aren't in the document do nothing.
    """
    d = _with(pages.where("NOT staged"), documents, commands, used)
    d = d.withColumn("__at", 2 * F.row_number().over(Window.partitionBy("documentid").orderBy("sortorder", "id")).cast("long"))
    spread = Window.partitionBy("documentid", F.coalesce("spreadid", -F.col("id")))
    half = lambda s: F.coalesce(F.max(F.when(F.col("spreadid").isNotNull() & (F.col("spreadside") == s), F.col("__at"))).over(spread), F.col("__at"))
    new = F.when(F.col("id") == F.col("c_id"), F.when(F.col("c_before"), half("left") - 1).otherwise(half("right") + 1))
    d = d.withColumn("__new", new)
    rows = F.array(F.struct(F.lit(False).alias("n"), F.col("__at").alias("at")), F.struct(F.lit(True).alias("n"), F.col("__new").alias("at")))
    d = d.withColumn("__x", F.explode(F.filter(rows, lambda r: r["at"].isNotNull())))
    fresh = F.col("__x.n")
    d = d.withColumns({c: F.when(~fresh, F.col(c)) for c in ("id", "spreadid", "spreadside", "pinside", "layoutside")}).withColumns({c: ~fresh & F.col(c) for c in ("filler", "__unused")}).withColumn("__at", F.col("__x.at"))
    return settled(d, "__at")


def move(pages: DataFrame, documents: DataFrame, commands: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Documents after commands (documentid, id, up), one for each document: the page, with its spread, changes places with its neighbour; at an end nothing moves."""
    d = _with(pages.where("NOT staged"), documents, commands, used)
    unit = F.min(F.struct("sortorder", "id")).over(Window.partitionBy("documentid", "__unused", F.coalesce("spreadid", -F.col("id"))))
    d = d.withColumn("__u", unit).withColumn("__rank", F.dense_rank().over(Window.partitionBy("documentid", "__unused").orderBy("__u")))
    kept = ~F.col("__unused")
    d = d.withColumn("__from", _whole(F.when(kept & (F.col("id") == F.col("c_id")), F.col("__rank")))).withColumn("__last", _whole(F.when(kept, F.col("__rank"))))
    to = F.when(F.col("c_up"), F.col("__from") - 1).otherwise(F.col("__from") + 1)
    d = d.withColumn("__to", F.when(to.between(1, F.col("__last")), to))
    rank = F.when(kept & F.col("__to").isNotNull() & (F.col("__rank") == F.col("__from")), F.col("__to")).when(kept & (F.col("__rank") == F.col("__to")), F.col("__from")).otherwise(F.col("__rank"))
    return settled(d.withColumn("__rank", rank), "__rank", "sortorder", "id")


def link(pages: DataFrame, documents: DataFrame, commands: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Documents after commands (documentid, id), one for each document: the page and the next one that is no filler become a spread without pins.

    A page in a spread, or whose successor is, stays as it is; so do fillers, the last page and staged pages.
    """
    d = _with(pages.where("NOT staged"), documents, commands, used)
    w = Window.partitionBy("documentid", "filler").orderBy("sortorder", "id")
    left = (F.col("id") == F.col("c_id")) & ~F.col("filler") & F.col("spreadid").isNull() & F.lead("id").over(w).isNotNull() & F.lead("spreadid").over(w).isNull()
    d = d.withColumn("__left", F.coalesce(left, F.lit(False)))
    d = d.withColumn("__right", F.coalesce(F.lag("__left").over(w), F.lit(False))).withColumn("__first", F.lag("id").over(w))
    half = F.col("__left") | F.col("__right")
    d = d.withColumns({
        "spreadid": F.when(F.col("__left"), F.col("id")).when(F.col("__right"), F.col("__first")).otherwise(F.col("spreadid")),
        "spreadside": F.when(F.col("__left"), "left").when(F.col("__right"), "right").otherwise(F.col("spreadside")), "pinside": F.when(~half, F.col("pinside")),
    })
    return settled(d, "sortorder", "id")


def turned_overlays(overlays: DataFrame, pages: DataFrame) -> DataFrame:
    """overlays with x mirrored on the pages that an arrangement has turned."""
    turned = pages.where("turned AND id IS NOT NULL").select(F.col("id").alias("pageid"), F.lit(True).alias("__t"))
    return overlays.join(turned, "pageid", "left").withColumn("x", F.when(F.col("__t"), mirrored(F.col("x"), F.col("w"))).otherwise(F.col("x"))).select(*overlays.columns)


def numbered(rows: DataFrame, first: Column | int, key: str, *order: str, where: Column | None = None, column: str = "id", buckets: int = 4096, counted: DataFrame | None = None) -> DataFrame:
    """rows with new ids ``first``, first + 1, ... in ``column``, in the order of key modulo ``buckets``, key, then order; with where only in rows where it holds.

    Rows are counted by bucket, the totals of the buckets (no more than their number) are summed up, and each
    bucket counts on from there, so that no task needs to see all rows and numbers don't depend on the partitioning.
    counted: the table that rows were joined from one to one, so that totals are counted without the joins.
    """
    counts = F.lit(True) if where is None else where
    place = F.row_number().over(Window.partitionBy("__b", "__c").orderBy(key, *order))

    def placed(rows: DataFrame) -> DataFrame:
        d = rows.withColumn("__b", F.pmod(F.col(key), F.lit(buckets))).withColumn("__c", F.coalesce(counts, F.lit(False)))
        return d.withColumn("__place", place)

    d = placed(rows)
    # the last place of a bucket is read from the same shuffle as the places, where rows are no wider than counted ones
    totals = placed(rows if counted is None else counted).where("__c").groupBy("__b").agg(F.max("__place").cast("long").alias("__n"))
    totals = totals.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"))
    d = d.withColumn("__place", F.col("__place") - 1).join(F.broadcast(totals), "__b", "left")
    new = (F.lit(first) if isinstance(first, int) else first) + F.col("__base") + F.col("__place")
    old = F.col(column) if column in rows.columns else F.lit(None).cast("long")
    return d.withColumn(column, F.when(F.col("__c"), new).otherwise(old).cast("long")).drop("__b", "__c", "__place", "__base")
