"""Whole documents copied or restored: new ids from bucket totals, and one map of keys for sources, pages, spreads, overlays and flow maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.keys import looked_up
from quire.functions.ranges import in_range
from quire.functions.tables import small_tasks
from quire.operators.arrange import arranged, numbered
from quire.operators.order import reading_order


def put_through(rows: DataFrame, column: str, keys: DataFrame, *scope: str) -> DataFrame:
    """rows with ``column`` put through keys (scope ..., old, new); what has no entry becomes null."""
    m = keys.select(*scope, F.col("old").alias(column), F.col("new").alias("__new"))
    d = looked_up(rows, column, m, *scope)
    return d.select(*[F.col("__new").alias(c) if c == column else F.col(c) for c in rows.columns])


def export_whole(documents: DataFrame, sources: DataFrame, pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """A row for each document with all its fields: document, sources (by id), pages (by order) with their overlays (by order); empty arrays where there are none.

    Overlays learn their document from the keys of pages and go there as rows; pages that lie by document already stay where they are.
    """
    def in_order(rows: Column, *order: str) -> Column:
        """An array of structs sorted by some of their fields (fields of any type may follow)."""
        at = lambda r: F.struct(*[r[c] for c in order])
        return F.array_sort(rows, lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0))

    # rows travel without what their keys say already
    o = overlays.select(F.col("pageid").alias("__page"), F.struct(*[c for c in overlays.columns if c != "pageid"]).alias("__o"))
    p = pages.where("documentid IS NOT NULL").select("documentid", F.col("id").alias("__page"), F.struct(*[c for c in pages.columns if c not in ("documentid", "id")]).alias("__p"))
    of = p.select("documentid", "__page").distinct()
    both = p.unionByName(o.join(of, "__page").repartition("documentid"), allowMissingColumns=True)
    full = both.groupBy("documentid", "__page").agg(F.collect_list("__p").alias("__p"), in_order(F.collect_list("__o"), "sortorder", "id").alias("__o"))
    its = F.transform("__o", lambda x: F.named_struct(*[n for c in overlays.columns for n in (F.lit(c), F.col("__page") if c == "pageid" else x[c])]))
    full = full.select("documentid", "__page", its.alias("overlays"), F.explode("__p").alias("__p"))
    known = {"documentid": F.col("documentid"), "id": F.col("__page")}
    full = full.select("documentid", F.struct(*[known.get(c, F.col(f"__p.{c}")).alias(c) for c in pages.columns], "overlays").alias("__x"))
    parts = {
        "sources": sources.select("documentid", F.struct(*sources.columns).alias("__x")).groupBy("documentid").agg(in_order(F.collect_list("__x"), "id").alias("__list")),
        "pages": full.groupBy("documentid").agg(in_order(F.collect_list("__x"), "sortorder", "id").alias("__list")),
    }
    d = documents.select("id", F.struct(*documents.columns).alias("document"))
    for name, part in parts.items():
        d = d.join(part.withColumnRenamed("documentid", "id"), "id", "left").withColumn(name, F.coalesce("__list", F.array().cast(part.schema["__list"].dataType))).drop("__list")
    return d.select("id", "document", "sources", "pages")


def tables_of(nested: DataFrame) -> dict[str, DataFrame]:
    """Documents of :func:`export_whole` as tables again. Sources and pages belong to the document they stand in, which keeps its rows where they are."""
    def rows(name: str) -> DataFrame:
        d = nested.select(F.col("id").alias("__d"), F.explode(name).alias("x"))
        mine = d.schema["x"].dataType
        return d.select(*[(F.col("__d").cast(mine[c].dataType) if c == "documentid" else F.col(f"x.{c}")).alias(c) for c in mine.names])

    pages = rows("pages")
    overlays = pages.select(F.explode("overlays").alias("o")).select("o.*")
    return {"document": nested.select("document.*"), "source": rows("sources"), "page": pages.drop("overlays"), "overlay": overlays}


def restored(tables: dict[str, DataFrame], first: dict[str, int], known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables document, source, page and overlay under new ids, counted from first[table] in the order of ids modulo 4096, then ids.

    Parents follow their children; a page's source that didn't come along becomes null, a spread's page as well,
    and then its side; of a flow map (source.flowmap, map from page to blocks) the pages that didn't come along go.
    known (id): documents that are here already; a masterid that isn't among them becomes null, and masterrange with it.

    Keys are numbered by themselves. Rows of a document get its new id where they are, before they are shuffled by their own.
    """
    small_tasks(tables["document"].sparkSession)

    def fresh(name: str, rows: DataFrame) -> DataFrame:
        """rows, made of those of a table, under their new ids."""
        given = numbered(rows, first[name], "id", column="__id", counted=tables[name].select("id"))
        return given.withColumn("id", F.col("__id")).drop("__id")

    keys = {name: numbered(tables[name].select("id"), first[name], "id", column="__id").select(F.col("id").alias("old"), F.col("__id").alias("new")) for name in ("document", "source", "page")}

    def moved(rows: DataFrame) -> DataFrame:
        d = rows.join(keys["document"].where("old IS NOT NULL").select(F.col("old").alias("documentid"), "new"), "documentid", "left")
        return d.select(*[F.col("new").alias(c) if c == "documentid" else F.col(c) for c in rows.columns])

    source, page = moved(tables["source"]), moved(tables["page"])
    if "flowmap" in source.columns:
        entries = tables["source"].select("id", F.explode("flowmap").alias("pageid", "blocks"))
        entries = entries.join(keys["page"].withColumnsRenamed({"old": "pageid", "new": "__p"}), "pageid")
        made = entries.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__p", "blocks")))).alias("__map"))
        empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<array<int>>"))
        source = source.withColumn("flowmap", F.col("flowmap").isNotNull()).join(made, "id", "left").withColumn("flowmap", F.when(F.col("flowmap"), F.coalesce("__map", empty))).select(*source.columns)
    page = put_through(put_through(fresh("page", page), "sourceid", keys["source"]), "spreadid", keys["page"])
    page = page.withColumn("spreadside", F.when(F.col("spreadid").isNotNull(), F.col("spreadside")))
    document = fresh("document", tables["document"])
    if known is not None:
        document = looked_up(document, "masterid", known.select(F.col("id").alias("masterid"), F.lit(True).alias("__k")).distinct())
        lost = [c for c in ("masterid", "masterrange") if c in tables["document"].columns]
        document = document.withColumns({c: F.when(F.col("__k"), F.col(c)) for c in lost}).select(*tables["document"].columns)
    return {"document": document, "source": fresh("source", source), "page": page, "overlay": put_through(fresh("overlay", tables["overlay"]), "pageid", keys["page"])}


def copied(tables: dict[str, DataFrame], commands: DataFrame, first: dict[str, int]) -> dict[str, DataFrame]:
    """Rows that commands (target, masterid, range), one for each target, add: source, page and overlay, and the targets' document rows.

    A target takes the pages of its master's range behind its own. New rows carry ``copied_from``, their ids are counted from
    first[table] in the order of targets modulo 4096. Each source comes along once for a target, whatever pages need it; a source
    that isn't there becomes null. A spread stays (under its first page's new id) if both halves came, pins stay. Overlays come with their pages.
    Lineage is recorded: masterid and masterrange of the targets. Balance the result with :func:`with_copies`.
    """
    small_tasks(commands.sparkSession)
    pages = tables["page"]
    counted = reading_order(pages).withColumn("__t", F.count("*").over(Window.partitionBy("documentid")))
    asked = commands.select("target", F.col("masterid").alias("documentid"), F.col("range").alias("__r"))
    taken = counted.join(asked, "documentid").where(in_range(F.col("__r"), F.col("position"), F.col("__t"))).drop("__r", "__t")
    taken = numbered(taken, first["page"], "target", "position", column="__id")
    needed = taken.where("sourceid IS NOT NULL").select("target", F.col("sourceid").alias("id")).distinct().join(tables["source"].drop("documentid"), "id")
    sources = numbered(needed, first["source"], "target", "id", column="__id")
    keys = sources.select("target", F.col("id").alias("old"), F.col("__id").alias("new"))
    both = Window.partitionBy("target", "spreadid")
    whole = F.col("spreadid").isNotNull() & (F.count("*").over(both) == 2)
    taken = taken.withColumn("__whole", whole).withColumn("__first", F.min("__id").over(both))
    last = pages.join(commands.select(F.col("target").alias("documentid")).distinct(), "documentid", "left_semi").groupBy(F.col("documentid").alias("target")).agg(F.max("sortorder").alias("__last"))
    taken = put_through(taken, "sourceid", keys, "target").join(last, "target", "left")
    place = F.row_number().over(Window.partitionBy("target").orderBy("position"))
    taken = taken.withColumns({"copied_from": F.col("id"), "id": F.col("__id"), "documentid": F.col("target"), "sortorder": F.coalesce("__last", F.lit(0)) + place, "spreadid": F.when(F.col("__whole"), F.col("__first")), "spreadside": F.when(F.col("__whole"), F.col("spreadside"))})
    overlays = tables["overlay"].join(taken.select(F.col("copied_from").alias("pageid"), F.col("id").alias("__page")), "pageid").withColumn("pageid", F.col("__page")).drop("__page")
    overlays = numbered(overlays.withColumn("copied_from", F.col("id")), first["overlay"], "pageid", "sortorder", "copied_from")
    lineage = commands.select(F.col("target").alias("id"), F.col("masterid").alias("__m"), F.col("range").alias("__r"))
    document = tables["document"].join(lineage, "id").withColumns({"masterid": F.col("__m"), "masterrange": F.col("__r")}).drop("__m", "__r")
    return {
        "document": document, "source": sources.withColumn("copied_from", F.col("id")).withColumn("id", F.col("__id")).withColumnRenamed("target", "documentid").drop("__id"),
        "page": taken.select(*pages.columns, "copied_from"), "overlay": overlays,
    }


def with_copies(tables: dict[str, DataFrame], made: dict[str, DataFrame]) -> DataFrame:
    """The targets' pages, old and new ones, balanced; see :func:`quire.operators.arrange.settled`."""
    targets = made["document"].select(F.col("id").alias("documentid"))
    mine = tables["page"].join(targets, "documentid", "left_semi").unionByName(made["page"].drop("copied_from"))
    used = tables["overlay"].select("pageid").unionByName(made["overlay"].select("pageid"))
    return arranged(mine, made["document"], used)


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables document, source, page, overlay and job after documents gone (id) went with all that is theirs, staged pages and jobs included; documents made from them stay and only lose the master."""
    ids = gone.select("id").distinct()
    left = tables["document"].join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("masterid"), F.lit(True).alias("__g"))
    left = looked_up(left, "masterid", lost).withColumn("masterid", F.when(F.col("__g").isNull(), F.col("masterid"))).select(*tables["document"].columns)
    theirs = ids.withColumnRenamed("id", "documentid")
    out = {name: tables[name].join(theirs, "documentid", "left_anti").select(*tables[name].columns) for name in ("source", "page", "job") if name in tables}
    gone_pages = tables["page"].join(theirs, "documentid", "left_semi").select(F.col("id").alias("pageid"))
    return {"document": left, **out, "overlay": tables["overlay"].join(gone_pages, "pageid", "left_anti").select(*tables["overlay"].columns)}


def without_pages(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables page and overlay after pages gone (id) went: their overlays go, and the other half of a spread is in none."""
    ids = gone.select("id").distinct().withColumn("__g", F.lit(True))
    d = tables["page"].join(ids, "id", "left")
    torn = F.col("spreadid").isNotNull() & (F.count_if(F.col("__g").isNotNull()).over(Window.partitionBy("documentid", "spreadid")) > 0)
    d = d.withColumn("__torn", torn).where("__g IS NULL").withColumns({c: F.when(~F.col("__torn"), F.col(c)) for c in ("spreadid", "spreadside")})
    return {"page": d.select(*tables["page"].columns), "overlay": tables["overlay"].join(ids.select(F.col("id").alias("pageid")), "pageid", "left_anti").select(*tables["overlay"].columns)}
