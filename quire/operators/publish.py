"""What readers see, and smaller edits of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranges import range_valid
from quire.operators.blocks import layout_segments
from quire.operators.impose import published_pages
from quire.operators.overlay import clean_settings

RULED = {"lines": (0.0, 8.0), "squares": (5.0, 5.0), "blank": (0.0, 0.0)}  # mm between vertical and horizontal rules


def visible_pages(pages: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """(userid, id, masked): editors see all pages of their documents, others the published ones, masked without ``viewsolutions``.

    grants (userid, documentid, edit, viewsolutions).
    """
    all_of = grants.where("edit").join(pages.where("NOT staged").select("documentid", "id"), "documentid")
    others = grants.where("NOT edit").join(published_pages(pages, documents).select("documentid", "id"), "documentid")
    return all_of.unionByName(others).select("userid", "id", (~F.col("viewsolutions") & ~F.col("edit")).alias("masked"))


def layout_pages(lines: DataFrame) -> DataFrame:
    """(documentid, page_no, content): a page for each segment of layout source; a source without text has one empty page."""
    d = layout_segments(lines)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    pages = d.groupBy("documentid", "segment").agg(F.array_join(parts, "\n").alias("content"))
    every = lines.select("documentid").distinct().join(pages, "documentid", "left")
    return every.select("documentid", (F.coalesce("segment", F.lit(0)) + 1).alias("page_no"), F.coalesce("content", F.lit("")).alias("content"))


def updated_layout(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(documentid, id, part, content, position) of a document's pages after layout pages got new source: lines (pageid, line_no, line).

    A page keeps the first part of its source, further parts are new pages (id null, part from 2) behind it. Pages without lines
    stay as they are (part 1, content as it was); position counts the document's pages that aren't staged.
    """
    parts = layout_pages(lines.withColumnRenamed("pageid", "documentid")).select(F.col("documentid").alias("id"), F.col("page_no").alias("part"), F.col("content").alias("__new"))
    d = pages.where("NOT staged").join(parts, "id", "left").withColumn("part", F.coalesce("part", F.lit(1)).cast("long"))
    w = Window.partitionBy("documentid").orderBy("sortorder", "id", "part")
    d = d.withColumn("position", F.row_number().over(w).cast("long")).withColumn("content", F.coalesce("__new", "content"))
    return d.select("documentid", F.when(F.col("part") == 1, F.col("id")).alias("id"), "part", "content", "position")


def image_texts(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs (id, src, alt, caption) with ``found`` and ``fallback``: missing pictures become [alt or caption], or nothing."""
    m = media.select("src").distinct().withColumn("__m", F.lit(True))
    name = F.coalesce(F.nullif("alt", F.lit("")), F.nullif("caption", F.lit("")))
    d = refs.join(m, "src", "left").withColumn("found", F.col("__m").isNotNull())
    return d.withColumn("fallback", F.when(~F.col("found"), F.coalesce(F.concat(F.lit("["), name, F.lit("]")), F.lit("")))).drop("__m")


def split_media(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks without bytes, media (sourceid, filename, data)): media are named index-name, and found again by that name."""
    named = blocks.withColumn("filename", F.when(F.col("data").isNotNull(), F.concat_ws("-", F.col("block_index").cast("string"), "filename")).otherwise(F.col("filename")))
    return named.drop("data"), named.where("data IS NOT NULL").select("sourceid", "filename", "data")


def joined_media(blocks: DataFrame, media: DataFrame) -> DataFrame:
    """blocks with their bytes again; missing media are empty."""
    return blocks.join(media, ["sourceid", "filename"], "left").withColumn("data", F.coalesce("data", F.to_binary(F.lit(""), F.lit("utf-8"))))


def upsert_overlays(overlays: DataFrame, changes: DataFrame) -> DataFrame:
    """overlays after changes (id, pageid, overlaytype, x, y, w, h, data): supplied fields replace old ones, new ids are added.

    A change of an old overlay to another type, and one of an unknown type, is left out. New overlays
    follow the last one of their page, in the order of their ids. Boxes are cut to the page and
    settings cleaned; the file name of an old overlay stays, a new one has none.
    """
    c = clamped_and_cleaned(changes).select("id", *[F.col(k).alias(f"__{k}") for k in ("pageid", "x", "y", "w", "h", "data")], F.col("overlaytype").alias("__type"))
    last = overlays.groupBy("pageid").agg(F.max("sortorder").alias("__last"))
    d = overlays.join(c, "id", "full").where("overlaytype IS NOT NULL OR __type IS NOT NULL")
    same = F.col("overlaytype").isNull() | (F.col("overlaytype") == F.col("__type"))
    put = lambda k: F.when(F.col("__type").isNotNull() & same, F.coalesce(F.col(f"__{k}"), F.col(k))).otherwise(F.col(k)).alias(k)
    has_file = F.col("__type").isin("audio", "imageframe") & same
    name = F.when(F.col("overlaytype").isNull(), F.lit("")).otherwise(F.coalesce(F.get_json_object("data", "$.filename"), F.lit("")))
    named = F.regexp_replace("__data", r'"filename":"(?:[^"\\]|\\.)*"', F.concat(F.lit('"filename":"'), F.regexp_replace(name, r'([\\$"])', r"\\$1"), F.lit('"')))
    d = d.withColumn("__data", F.when(has_file & F.col("__data").isNotNull(), named).otherwise(F.col("__data")))
    fresh = F.col("overlaytype").isNull()
    d = d.select("id", put("pageid"), F.coalesce("overlaytype", "__type").alias("overlaytype"), *[put(k) for k in ("x", "y", "w", "h", "data")], "sortorder", fresh.alias("__new"))
    place = F.row_number().over(Window.partitionBy("pageid", "__new").orderBy("id"))
    d = d.withColumn("__k", place).join(last, "pageid", "left")
    order = F.coalesce(F.col("sortorder"), (F.coalesce("__last", F.lit(0)) + F.col("__k")).cast(overlays.schema["sortorder"].dataType))
    return d.select("id", "pageid", "overlaytype", "x", "y", "w", "h", "data", order.alias("sortorder"))


def clamped_and_cleaned(changes: DataFrame) -> DataFrame:
    """changes of known types with their boxes cut to the page and their data cleaned; fields that aren't supplied stay null."""
    cut = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))) for c in "xywh"}
    d = clean_settings(changes).withColumns(cut)
    d = d.withColumns({"w": F.when(F.col("x").isNotNull(), F.least("w", 1 - F.col("x"))).otherwise(F.col("w")), "h": F.when(F.col("y").isNotNull(), F.least("h", 1 - F.col("y"))).otherwise(F.col("h"))})
    return d.withColumn("data", F.when(F.col("data").isNotNull(), F.col("settings"))).drop("settings")


def filled_pages(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """pages after changes of overlays (pageid): content makes an automatic blank page an ordinary one."""
    touched = changes.select(F.col("pageid").alias("id")).distinct().withColumn("__touched", F.lit(True))
    return pages.join(touched, "id", "left").withColumn("filler", F.col("filler") & F.col("__touched").isNull()).select(*pages.columns)


def decoded_links(rows: DataFrame, mapping: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """rows with link tokens put through mapping (old, new); tokens without an entry lose their id."""
    ids = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"@@DOC\*(\d+)@@"), F.lit(1)))).alias("old"))
    new = ids.withColumn("old", F.col("old").cast("long")).join(mapping, "old", "left").groupBy(key).agg(F.collect_list(F.struct("old", "new")).alias("__m"))
    put = F.aggregate(F.coalesce("__m", F.array().cast(new.schema["__m"].dataType)), F.col(text), lambda acc, m: F.replace(acc, F.concat(F.lit("@@DOC*"), m["old"].cast("string"), F.lit("@@")), F.coalesce(m["new"].cast("string"), F.lit(""))))
    return rows.join(new, key, "left").withColumn(text, put).drop("__m")


def worksheet_lines(sheets: DataFrame, width: float = 210.0, height: float = 297.0, margin: float = 15.0) -> DataFrame:
    """sheets (id, template, count, landscape) -> (id, page_no, x1, y1, x2, y2): rules of 1 to 50 blank pages, in mm; unknown templates are blank."""
    n = F.greatest(F.lit(1), F.least(F.lit(50), F.col("count")))
    d = sheets.select("id", "template", F.when(F.col("landscape"), height).otherwise(width).alias("w"), F.when(F.col("landscape"), width).otherwise(height).alias("h"), F.explode(F.sequence(F.lit(1), n)).alias("page_no"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    rules = none
    for name, (dx, dy) in RULED.items():
        across = F.transform(F.sequence(F.lit(1), F.floor((F.col("h") - 2 * margin) / dy).cast("int")), lambda i, dy=dy: F.struct(F.lit(margin).alias("x1"), (margin + i * dy).alias("y1"), (F.col("w") - margin).alias("x2"), (margin + i * dy).alias("y2"))) if dy else none
        down = F.transform(F.sequence(F.lit(1), F.floor((F.col("w") - 2 * margin) / dx).cast("int")), lambda i, dx=dx: F.struct((margin + i * dx).alias("x1"), F.lit(margin).alias("y1"), (margin + i * dx).alias("x2"), (F.col("h") - margin).alias("y2"))) if dx else none
        rules = F.when(F.col("template") == name, F.concat(across, down)).otherwise(rules)
    return d.select("id", "page_no", F.inline(rules))


def course_documents(documents: DataFrame, courses: DataFrame) -> DataFrame:
    """documents of the named courses (course)."""
    return documents.join(courses.select("course").distinct(), "course", "left_semi").select(*documents.columns)


def new_documents(rows: DataFrame, now: Column) -> DataFrame:
    """rows as documents to be added: the range without blanks around it, both times set."""
    return rows.withColumns({"pagerange": F.trim(F.coalesce("pagerange", F.lit(""))), "timecreated": now, "timemodified": now})


def publish_settings(documents: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): documents after changes (id, pagerange and other fields, one row for each document).

    Fields that are null stay as they are; a range loses the blanks around it, and one that is no range rejects the whole
    change with a message; a change of a document that isn't there is rejected as well. timemodified (if documents have it) becomes now.
    """
    fields = [c for c in changes.columns if c != "id"]
    bad = F.when(F.col("pagerange").isNotNull() & ~range_valid(F.trim("pagerange")), F.lit("not a page range"))
    known = documents.select("id", F.lit(True).alias("__k"))
    asked = changes.join(known, "id", "left").withColumn("message", F.coalesce(F.when(F.col("__k").isNull(), "unknown document"), bad)).drop("__k")
    good = asked.where("message IS NULL").select("id", *[(F.trim(c) if c == "pagerange" else F.col(c)).alias(f"__{c}") for c in fields], F.lit(True).alias("__go"))
    d = documents.join(good, "id", "left")
    put = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields if c in documents.columns}
    if "timemodified" in documents.columns:
        put["timemodified"] = F.when(F.col("__go"), now).otherwise(F.col("timemodified"))
    return d.withColumns(put).select(*documents.columns), asked.where("message IS NOT NULL")
