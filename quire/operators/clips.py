"""Clips, snippet images and notes of imported text: names are keys, all lookups are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.tables import small_tasks

CLIP = r"^ausschnitt-(\d+)\.png$"  # fixed value: the name of a numbered clip
STORED = r"^@@PLUGINFILE@@/"  # fixed value: the mark before a stored file's name


def next_clip(clips: DataFrame, key: str = "documentid") -> DataFrame:
    """(key, next): the number after the highest numbered clip of each key; 1 where none is numbered."""
    n = F.regexp_extract("filename", CLIP, 1).try_cast("long")
    return clips.groupBy(key).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def missing_clips(published: DataFrame, own: DataFrame, commands: DataFrame) -> DataFrame:
    """(documentid, filename, copied_from): the clips of masters (documentid, filename) that commands (target, masterid) have to copy.

    A clip of the same name that the target already has stays; of two masters with one name the lower id gives it.
    """
    small_tasks(published.sparkSession)
    d = published.join(commands.select("target", F.col("masterid").alias("documentid")).distinct(), "documentid")
    d = d.groupBy(F.col("target"), "filename").agg(F.min("documentid").alias("copied_from")).withColumnRenamed("target", "documentid")
    return d.join(own.select("documentid", "filename").distinct(), ["documentid", "filename"], "left_anti").select("documentid", "filename", "copied_from")


def stored_name(src: Column) -> Column:
    """The file that a snippet's image address means: without the mark of stored files, percent signs decoded (a plus stays)."""
    return F.try_url_decode(F.replace(F.regexp_replace(src, STORED, ""), F.lit("+"), F.lit("%2B")))


def snippet_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (sourceid, src, ...) with ``filename``: the named image among files (sourceid, filename), null if it isn't there."""
    have = files.select("sourceid", F.col("filename").alias("__f")).distinct()
    d = refs.withColumn("__n", stored_name(F.col("src")))
    return d.join(have, (d["sourceid"] == have["sourceid"]) & (d["__n"] == have["__f"]), "left").select(*[d[c] for c in refs.columns], F.col("__f").alias("filename"))


def layout_images(refs: DataFrame, clips: DataFrame, printed: bool = False) -> DataFrame:
    """refs (id, documentid, src, alt) -> (id, url, fallback): the clip of that name, else on screen a web address itself, else the text."""
    small_tasks(refs.sparkSession)
    have = clips.select("documentid", F.col("filename").alias("src"), F.lit(True).alias("__k")).distinct()
    d = refs.join(have, ["documentid", "src"], "left")
    web = F.lit(not printed) & F.coalesce(F.rlike("src", F.lit("(?i)^https?://")), F.lit(False))
    url = F.when(F.col("__k") | web, F.col("src"))
    text = F.when(F.coalesce("alt", F.lit("")) != "", F.concat(F.lit("["), "alt", F.lit("]"))).otherwise("")
    return d.select("id", url.alias("url"), F.when(url.isNull(), text).alias("fallback"))


def remap_glossaries(overlays: DataFrame, mapping: DataFrame, glossaries: DataFrame) -> DataFrame:
    """overlays (id, course, glossaryid) after a restore: the mapped glossary, else the old one if the course has it, else 0."""
    m = mapping.select(F.col("old").alias("glossaryid"), F.col("new").alias("__new"))
    here = glossaries.select(F.col("id").alias("glossaryid"), "course", F.lit(True).alias("__k")).distinct()
    d = overlays.join(m, "glossaryid", "left").join(here, ["glossaryid", "course"], "left")
    kept = F.when(F.col("__k"), F.col("glossaryid")).otherwise(0)
    given = F.coalesce("glossaryid", F.lit(0)) == 0
    return d.withColumn("glossaryid", F.when(given, F.col("glossaryid")).otherwise(F.coalesce("__new", kept))).select(*overlays.columns)


def hidden_passages(blocks: DataFrame, hidden: DataFrame) -> DataFrame:
    """(sourceid, passages, hidden): blocks (sourceid, block_index) of each source and how many of them are left out."""
    h = hidden.select("sourceid", "block_index", F.lit(True).alias("__h")).distinct()
    return blocks.join(h, ["sourceid", "block_index"], "left").groupBy("sourceid").agg(F.count("*").alias("passages"), F.count_if("__h").alias("hidden"))


def footnotes(html: DataFrame, key: str) -> DataFrame:
    """(key, note_no, target, text) of html: the references to footnotes in order, each with its definition.

    A reference is a link to #fn..., a definition a list item of such an id, without its links back;
    of several definitions the last holds. References without one are left alone.
    """
    refs = html.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"']#(fn[^\"']*)[\"']"), 1)).alias("pos", "target"))
    items = html.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<li\b[^>]*id\s*=\s*[\"']fn[^>]*>.*?)</li>"), 1)).alias("pos", "item"))
    text = F.regexp_replace("item", r"(?is)<a\b[^>]*href\s*=\s*[\"']#fnref[^>]*>.*?</a>", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "(?is)<[^>]+>", ""), r"\s+", " "))
    found = items.select(key, F.regexp_extract("item", r"(?is)id\s*=\s*[\"'](fn[^\"']*)", 1).alias("target"), F.struct("pos", text.alias("text")).alias("d"))
    found = found.groupBy(key, "target").agg(F.max("d")["text"].alias("text")).where("text <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    return refs.join(found, [key, "target"]).select(key, F.row_number().over(w).alias("note_no"), "target", "text")


def writing_lines(n: Column) -> Column:
    """Lines to write on: 1 to 40, five where none is given; no number counts as none of them."""
    return F.when(n.isNull(), 5).otherwise(F.greatest(F.lit(1), F.least(F.lit(40), F.coalesce(F.regexp_extract(n, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))))


def safe_classes(classes: Column) -> Column:
    """The class names that may stand in a page: a letter, then letters, digits, - and _."""
    return F.filter(classes, lambda c: F.rlike(c, F.lit(r"^[A-Za-z][A-Za-z0-9_-]*$")))


def stale_measures(measures: DataFrame, now: DataFrame) -> DataFrame:
    """(sourceid) whose measures (sourceid, fonts, style, geometry) were taken under other settings than now (the same columns)."""
    key = lambda d: d.select("sourceid", F.sha2(F.to_json(F.struct("fonts", "style", "geometry")), 256).alias("__k"))
    return key(measures).join(key(now), ["sourceid", "__k"], "left_anti").select("sourceid").distinct()


def mean_luminance(pixels: DataFrame, sizes: DataFrame | None = None, key: str = "page") -> DataFrame:
    """(key, mean, invert): mean of pixels (key, x, y, lum) on a grid of about 150 points a side; dark pages are printed inverted.

    Pixels with width and height of their page are thinned out where they are, and only sums are shuffled. Else sizes
    (key, width, height) gives the step; without it each page's largest x and y are found first, by a pre-aggregated pass.
    """
    wide = F.greatest(F.lit(1), F.floor(F.greatest("width", "height") / 150)).cast("long")
    if sizes is None and {"width", "height"} <= set(pixels.columns):
        d = pixels.withColumn("__s", wide).where("x % __s = 0 AND y % __s = 0")
        return d.groupBy(key).agg(F.avg("lum").alias("mean")).withColumn("invert", F.col("mean") < 100)
    if sizes is None:
        sizes = pixels.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    step = sizes.select(key, wide.alias("__s"))
    d = pixels.join(step, key).where("x % __s = 0 AND y % __s = 0")
    return d.groupBy(key).agg(F.avg("lum").alias("mean")).withColumn("invert", F.col("mean") < 100)
