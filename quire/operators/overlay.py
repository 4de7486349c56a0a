"""Overlays: settings, order, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import clamp_box
from quire.functions.text import purified

FRAMES = ("textframe", "imageframe")
TYPES = ("textframe", "imageframe", "textbox", "mask", "audio", "glossary", "reflow", "column")


def clamped(overlays: DataFrame) -> DataFrame:
    """overlays of known types with boxes cut to their page; unknown types are rejected."""
    d = overlays.where(F.col("overlaytype").isin(*TYPES)).withColumn("__b", clamp_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return d.select(*[F.col("__b")[c].alias(c) if c in "xywh" else F.col(c) for c in overlays.columns])


def normal_color(v: Column, default: str) -> Column:
    """#rrggbb in lower case, or the default."""
    return F.when(F.rlike(v, F.lit("^#[0-9a-fA-F]{6}$")), F.lower(v)).otherwise(default)


# The settings that each type may have.
KEYS = ("text", "fontsize", "bold", "color", "bgcolor", "align", "style", "revealable", "label", "mode", "ttstext", "ttslang", "filename", "glossaryid", "term", "role", "html", "fontscale", "border", "columns", "fit", "alt", "caption")


def clean_settings(overlays: DataFrame, json_col: str = "data") -> DataFrame:
    """overlays with ``settings`` (JSON): the allowed keys of their type, clamped, defaults filled in; unknown types go.

    Texts lose their tags, html everything but known elements and attributes, file names their separators. A value that is no
    number counts as 0 before it is clamped; text that is no JSON object has no values.
    """
    raw = F.from_json(F.coalesce(F.col(json_col), F.lit("{}")), "struct<" + ",".join(f"{k}:string" for k in KEYS) + ">")
    v = lambda k: F.col("__s")[k]
    text = lambda k: F.regexp_replace(F.coalesce(v(k), F.lit("")), "<[^>]*>", "").alias(k)
    flag = lambda k: (~F.coalesce(v(k), F.lit("")).isin("", "0", "false")).alias(k)
    one_of = lambda k, known, default: F.when(v(k).isin(*known), v(k)).otherwise(default).alias(k)
    number = lambda k, default: F.when(v(k).isNull(), F.lit(float(default))).otherwise(F.coalesce(v(k).try_cast("double"), F.lit(0.0)))
    whole = lambda k, default: number(k, default).cast("long")
    within = lambda k, c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).alias(k)
    color = lambda k, default: normal_color(F.trim(F.coalesce(v(k), F.lit(""))), default).alias(k)
    file = F.regexp_replace(F.regexp_replace(F.coalesce(v("filename"), F.lit("")), r"""[\x00-\x1f\x7f&<>"`|':\\/]""", ""), r"\.\.+", "").alias("filename")
    lang = F.when(F.rlike(v("ttslang"), F.lit("^[a-z]{2,3}(-[A-Za-z]{2,4})?$")), v("ttslang")).otherwise("de-DE").alias("ttslang")
    by_type = {
        "textbox": [text("text"), within("fontsize", whole("fontsize", 16), 6, 96), flag("bold"), color("color", "#000000"), color("bgcolor", "#ffffff"), one_of("align", ("left", "center", "right"), "left")],
        "mask": [one_of("style", ("black",), "white"), flag("revealable"), text("label")],
        "audio": [one_of("mode", ("tts",), "file"), text("ttstext"), lang, text("label"), file],
        "glossary": [whole("glossaryid", 0).alias("glossaryid"), text("term")],
        "reflow": [text("text"), one_of("role", ("p", "h2", "h3", "li"), "p")],
        "textframe": [purified(F.coalesce(v("html"), F.lit(""))).alias("html"), within("fontscale", F.round(number("fontscale", 1), 2), 0.5, 3.0), color("bgcolor", ""), flag("border"), within("columns", whole("columns", 1), 1, 3), one_of("style", ("tufte", "sidenote"), "")],
        "imageframe": [file, one_of("fit", ("cover",), "contain"), text("alt"), text("caption")],
    }
    out = F.when(F.col("overlaytype") == "column", F.lit("{}"))
    for name, fields in by_type.items():
        out = out.when(F.col("overlaytype") == name, F.to_json(F.struct(*fields)))
    return overlays.where(F.col("overlaytype").isin(*TYPES)).withColumn("__s", raw).withColumn("settings", out).drop("__s")


def page_overlays(pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(id, overlays): every page with its overlay ids in order, none for bare pages."""
    o = overlays.groupBy(F.col("pageid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sortorder", F.col("id").alias("o")))), lambda x: x["o"]).alias("overlays"))
    return pages.select("id").join(o, "id", "left").withColumn("overlays", F.coalesce("overlays", F.array().cast("array<bigint>")))


def reading_order(overlays: DataFrame) -> DataFrame:
    """(pageid, id, rank) of the text view: by x to one tenth, then y, then overlay order."""
    shown = overlays.where(F.col("overlaytype").isin("reflow", "textframe", "imageframe"))
    w = Window.partitionBy("pageid").orderBy(F.round("x", 1), "y", "sortorder", "id")
    return shown.select("pageid", "id", F.row_number().over(w).alias("rank"))


def z_order(overlays: DataFrame) -> DataFrame:
    """(pageid, id, z): frames below the interactive layers."""
    w = Window.partitionBy("pageid").orderBy((~F.col("overlaytype").isin(*FRAMES)).cast("int"), "sortorder", "id")
    return overlays.select("pageid", "id", F.row_number().over(w).alias("z"))


def page_facts(pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(id, documentid, frames, blank, has_text): text frames, no overlay at all, and whether there is a text view."""
    n = overlays.groupBy(F.col("pageid").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("overlaytype") == "textframe").alias("frames"), F.bool_or(F.col("overlaytype").isin("reflow", "textframe")).alias("has_text"))
    d = pages.select("id", "documentid").join(n, "id", "left")
    return d.select("id", "documentid", F.coalesce("frames", F.lit(0)).alias("frames"), F.col("n").isNull().alias("blank"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def documents_with_text(pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(documentid, has_text): whether any page of a document has a text view."""
    return page_facts(pages, overlays).groupBy("documentid").agg(F.bool_or("has_text").alias("has_text"))


def column_numbers(overlays: DataFrame) -> DataFrame:
    """(pageid, id, column_no) of zoom regions."""
    w = Window.partitionBy("pageid").orderBy("sortorder", "id")
    return overlays.where("overlaytype = 'column'").select("pageid", "id", F.row_number().over(w).alias("column_no"))


def mask_keys(overlays: DataFrame, images: DataFrame) -> DataFrame:
    """(pageid, masks, key): pages with masks that can't be lifted, and a key over the picture, their boxes and styles.

    overlays have their settings as JSON in ``data``; images are (pageid, contenthash). Pages without
    a picture have no key.
    """
    setting = lambda k: F.get_json_object("data", f"$.{k}")
    m = overlays.where("overlaytype = 'mask'").where(F.coalesce(setting("revealable"), F.lit("")).isin("", "0", "false"))
    style = F.when(setting("style") == "black", "black").otherwise("white")
    box = F.concat_ws(",", *[F.format_string("%.6f", F.col(c).cast("double")) for c in "xywh"], style)
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("sortorder", "id", box.alias("b")))), lambda x: x["b"])
    found = m.groupBy("pageid").agg(F.count("*").alias("masks"), F.array_join(boxes, ";").alias("b")).join(images, "pageid")
    return found.select("pageid", "masks", F.md5(F.concat_ws(";", "contenthash", "b").cast("binary")).alias("key"))


def overset(frames: DataFrame) -> DataFrame:
    """frames (id, h, needed) whose text needs more height than they have."""
    return frames.where("needed > h").select("id", (F.col("needed") - F.col("h")).alias("missing"))
