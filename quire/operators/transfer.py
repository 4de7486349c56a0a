"""Copying, exporting and deleting documents with their pages, overlays and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.keys import looked_up


def export_nested(documents: DataFrame, pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(id, pages array<struct<id, sortorder, overlays array<struct<id, sortorder, overlaytype>>>>), in order; bare documents included."""
    o = overlays.groupBy("pageid").agg(F.array_sort(F.collect_list(F.struct("sortorder", "id", "overlaytype"))).alias("overlays"))
    p = pages.join(o, F.col("id") == F.col("pageid"), "left").select("documentid", F.struct("sortorder", "id", F.coalesce("overlays", F.array().cast(o.schema["overlays"].dataType)).alias("overlays")).alias("p"))
    nested = p.groupBy("documentid").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    return documents.join(nested, F.col("id") == F.col("documentid"), "left").select("id", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)).alias("pages"))


def import_nested(nested: DataFrame, offset: int) -> tuple[DataFrame, DataFrame]:
    """Pages and overlays of nested documents, all ids moved by ``offset``."""
    p = nested.select((F.col("id") + offset).alias("documentid"), F.explode("pages").alias("p"))
    pages = p.select("documentid", (F.col("p.id") + offset).alias("id"), "p.sortorder")
    o = p.select((F.col("p.id") + offset).alias("pageid"), F.explode("p.overlays").alias("o")).select("pageid", (F.col("o.id") + offset).alias("id"), "o.sortorder", "o.overlaytype")
    return pages, o


def broken_spreads(pages: DataFrame) -> DataFrame:
    """(documentid, spreadid) of spreads with fewer than two pages."""
    return pages.where("spreadid IS NOT NULL").groupBy("documentid", "spreadid").agg(F.count("*").alias("n")).where("n < 2").select("documentid", "spreadid")


def without_broken_spreads(pages: DataFrame) -> DataFrame:
    """pages, those of broken spreads being in none."""
    w = Window.partitionBy("documentid", "spreadid")
    ok = F.col("spreadid").isNotNull() & (F.count("*").over(w) >= 2)
    return pages.withColumn("__ok", ok).withColumns({"spreadid": F.when(F.col("__ok"), F.col("spreadid")), "spreadside": F.when(F.col("__ok"), F.col("spreadside"))}).select(*pages.columns)


def copy_pages(published: DataFrame, commands: DataFrame) -> DataFrame:
    """(documentid, id, sortorder, copied_from, spreadid, spreadside): commands (target, masterid) take the published pages of masters.

    A copy's id is made of its target and its place there, so that no two tasks have to agree on
    numbers. A spread is kept (renamed to its left page's new id) only if both halves came along.
    """
    d = published.join(commands.select("target", F.col("masterid").alias("documentid")).distinct(), "documentid")
    n = F.row_number().over(Window.partitionBy("target").orderBy("documentid", "pagenumber")).cast("long")
    d = d.withColumn("__n", n)
    both = Window.partitionBy("target", "documentid", "spreadid")
    d = d.withColumn("__ok", F.col("spreadid").isNotNull() & (F.count("*").over(both) == 2)).withColumn("__l", F.min("__n").over(both))
    new = lambda c: F.col("target") * (1 << 20) + F.col(c)
    return d.select(
        F.col("target").alias("documentid"), new("__n").alias("id"), F.col("__n").alias("sortorder"), F.col("id").alias("copied_from"),
        F.when(F.col("__ok"), new("__l")).alias("spreadid"), F.when(F.col("__ok"), F.col("spreadside")).alias("spreadside"),
    )


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with ``column`` put through mapping (old, new); what has no entry becomes null."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return looked_up(rows, column, m).select(*[F.col("__new").alias(c) if c == column else F.col(c) for c in rows.columns])


def without_lost_masters(documents: DataFrame) -> DataFrame:
    """documents whose masterid is null where that master isn't here."""
    here = documents.select(F.col("id").alias("masterid"), F.lit(True).alias("__k"))
    return looked_up(documents, "masterid", here).withColumn("masterid", F.when(F.col("__k"), F.col("masterid"))).select(*documents.columns)


def orphans(documents: DataFrame, pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(kind, id): overlays without a page, pages without a document."""
    o = overlays.join(pages.select(F.col("id").alias("pageid")), "pageid", "left_anti").select(F.lit("overlay").alias("kind"), "id")
    p = pages.join(documents.select(F.col("id").alias("documentid")), "documentid", "left_anti").select(F.lit("page").alias("kind"), "id")
    return o.unionByName(p)


def delete_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """pages after sources (id) went: their staged pages go, pages of documents only lose the source."""
    gone = sources.select(F.col("id").alias("sourceid"), F.lit(True).alias("__g"))
    d = pages.join(gone, "sourceid", "left").where(~(F.coalesce("__g", F.lit(False)) & F.col("staged")))
    return d.withColumn("sourceid", F.when(F.col("__g").isNull(), F.col("sourceid"))).select(*pages.columns)


def delete_documents(gone: DataFrame, documents: DataFrame, pages: DataFrame, overlays: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, overlays) after gone (id) went; documents made from them stay and lose only the master."""
    ids = gone.select("id").distinct()
    left = documents.join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("masterid"), F.lit(True).alias("__g"))
    left = looked_up(left, "masterid", lost).withColumn("masterid", F.when(F.col("__g").isNull(), F.col("masterid"))).select(*documents.columns)
    kept = pages.join(ids.select(F.col("id").alias("documentid")), "documentid", "left_anti").select(*pages.columns)
    over = overlays.join(kept.select(F.col("id").alias("pageid")), "pageid", "left_semi").select(*overlays.columns)
    return left, kept, over
