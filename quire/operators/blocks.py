"""Blocks of HTML, Markdown and layout source, from token and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html", notes: str = "") -> DataFrame:
    """(key, pos, token, tag, closing) of the bodies' tokens. The array named by notes follows as empty tokens with mark (its place) and note (its html)."""
    tokens = T.tokens(T.body(F.col(html)))
    if notes:
        item = lambda token, mark, note: F.struct(token.alias("token"), mark.alias("mark"), note.alias("note"))
        found = F.transform(tokens, lambda t: item(t, F.lit(None).cast("int"), F.lit(None).cast("string")))
        behind = F.transform(notes, lambda x, i: item(F.lit(""), i, x["html"]))
        d = pages.select(key, F.posexplode(F.concat(found, behind)).alias("pos", "x")).select(key, "pos", "x.*")
    else:
        d = pages.select(key, F.posexplode(tokens).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    return d.withColumn("tag", tag).withColumn("closing", F.startswith("token", F.lit("</")))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_index, tag, text): outermost text elements in reading order; loose text becomes p, containers are transparent.

    Paragraphs and headings end where the next block begins; lists, tables, quotes and preformatted
    text hold everything up to their own end.
    """
    d = html_tokens(pages, key, html)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nest = F.col("tag").isin("ul", "ol", "table", "blockquote", "pre")
    step = F.when(nest & F.col("closing"), -1).when(nest, 1).otherwise(0)
    d = d.withColumn("c", F.sum(step).over(w)).withColumn("low", F.least(F.lit(0), F.min("c").over(w)))
    d = d.withColumn("depth", F.col("c") - F.col("low"))
    inside = F.when(nest & ~F.col("closing"), F.col("depth") > 1).otherwise(F.col("depth") > 0)  # within an outer list or table
    flat = F.col("tag").isin("p", "h1", "h2", "h3", "h4", "h5", "h6")
    edge = F.col("tag").isin("div", "section", "article", "main", "header", "footer", "nav", "body", "hr", "form", "aside")
    starts = ~inside & (flat | edge | nest)
    starts = F.when(nest & F.col("closing"), F.col("depth") == 0).otherwise(starts)
    d = d.withColumn("seg", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    name = F.max_by(F.when(~F.col("closing") & (flat | nest), F.col("tag")), F.when(~F.col("closing") & (flat | nest), -F.col("pos")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "", F.struct("pos", "token")))), lambda x: x["token"])
    b = d.groupBy(key, "seg").agg(name.alias("tag"), T.plain_text(F.array_join(parts, " ")).alias("text"))
    b = b.where("text <> ''").withColumn("tag", F.coalesce("tag", F.lit("p")))
    return b.withColumn("block_index", F.row_number().over(Window.partitionBy(key).orderBy("seg")) - 1).drop("seg")


def import_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", notes: str = "") -> DataFrame:
    """(key, block_index, kind, tag, html, text, src, alt, caption): text elements, images and page breaks in reading order.

    Text blocks are those of :func:`html_blocks`, with their markup and without their images, which
    follow them; a page-break hr (by class or style) is a block. The caption of a figure goes to its
    images, or is a paragraph where it has none. A null html gives no blocks. ``notes`` names an array of
    struct<html>: each is a row of kind note (tag: its place in the array) behind the page's blocks, so that what made pages is read once.
    """
    d = html_tokens(pages, key, html, notes).repartition(key)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nest = F.col("tag").isin("ul", "ol", "dl", "table", "blockquote", "pre")
    step = F.when(nest & F.col("closing"), -1).when(nest, 1).otherwise(0)
    d = d.withColumn("c", F.sum(step).over(w)).withColumn("low", F.least(F.lit(0), F.min("c").over(w)))
    d = d.withColumn("depth", F.col("c") - F.col("low"))
    inside = F.when(nest & ~F.col("closing"), F.col("depth") > 1).otherwise(F.col("depth") > 0)
    flat = F.col("tag").isin("p", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption")
    edge = F.col("tag").isin("div", "section", "article", "main", "header", "footer", "nav", "body", "hr", "form", "aside", "figure")
    starts = F.when(nest & F.col("closing"), F.col("depth") == 0).otherwise(~inside & (flat | edge | nest))
    d = d.withColumn("__starts", starts).withColumn("seg", F.sum(F.col("__starts").cast("int")).over(w))
    figure = F.sum(F.when(F.col("tag") == "figure", F.when(F.col("closing"), 0).otherwise(1)).otherwise(0)).over(w)
    d = d.withColumn("figure", figure).withColumn("__in", F.sum(F.when(F.col("tag") == "figure", F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)).over(w) > 0)
    attr = lambda k: F.trim(F.regexp_replace(F.regexp_extract("token", rf"""(?is)\s{k}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", ""))
    picture = (F.col("tag") == "img") & ~F.col("closing")
    name = F.max_by(F.when(F.col("__starts") & ~F.col("closing") & (flat | nest), F.col("tag")), F.when(F.col("__starts") & ~F.col("closing") & (flat | nest), -F.col("pos")))
    kept = F.when(~F.col("__starts") & ~picture & (F.col("tag") != "picture") & ~F.startswith("token", F.lit("<!")), F.struct("pos", "token"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["token"]), "")
    broken = F.max(F.when((F.col("tag") == "hr") & F.rlike(F.concat_ws(" ", attr("class"), attr("style")), F.lit("(?i)page-?break")), 1).otherwise(0)) == 1
    pictures = F.array_sort(F.collect_list(F.when(picture, F.struct("pos", attr("src").alias("src"), attr("alt").alias("alt")))))
    apart = [F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("pos", "mark", "note")))).alias("__notes")] if notes else []
    seg = d.groupBy(key, "seg").agg(name.alias("tag"), joined.alias("inner"), F.max(F.when(F.col("__in"), F.col("figure"))).alias("figure"), broken.alias("broken"), pictures.alias("pictures"), *apart)
    seg = seg.withColumn("text", T.plain_text(F.col("inner")))
    same = Window.partitionBy(key, "figure")
    label = (F.col("tag") == "figcaption") & (F.col("text") != "")
    seg = seg.withColumn("caption", F.when(F.col("figure").isNotNull(), F.max_by(F.when(label, F.col("text")), F.when(label, F.col("seg"))).over(same)))
    filled = F.col("figure").isNotNull() & (F.max(F.size("pictures")).over(same) > 0)
    seg = seg.withColumn("__label", F.coalesce((F.col("tag") == "figcaption") & filled, F.lit(False)))
    tag = F.when(F.coalesce("tag", F.lit("figcaption")) == "figcaption", "p").otherwise(F.col("tag"))
    made = F.concat(F.lit("<"), tag, F.lit(">"), F.trim("inner"), F.lit("</"), tag, F.lit(">"))
    none = F.lit(None).cast("string")
    row = lambda kind, tag, html, text, src, alt, caption: F.struct(F.lit(kind).alias("kind"), tag.alias("tag"), html.alias("html"), text.alias("text"), src.alias("src"), alt.alias("alt"), caption.alias("caption"))
    broke = F.when(F.col("broken"), F.array(row("pagebreak", none, none, none, none, none, none))).otherwise(F.array())
    words = F.when((F.col("text") != "") & ~F.col("__label"), F.array(row("text", tag, made, F.col("text"), none, none, none))).otherwise(F.array())
    images_ = F.transform("pictures", lambda p: row("image", F.lit("img"), none, none, p["src"], p["alt"], F.coalesce("caption", F.lit(""))))
    apart = [F.transform("__notes", lambda x: row("note", x["mark"].cast("string"), x["note"], none, none, none, none))] if notes else []
    every = seg.select(key, "seg", F.posexplode(F.concat(broke, words, images_, *apart)).alias("n", "x"))
    return every.withColumn("block_index", F.row_number().over(Window.partitionBy(key).orderBy("seg", "n")) - 1).select(key, "block_index", "x.*")


def resolved_images(blocks: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Blocks of :func:`import_blocks` with width, height and filename of their image; media (src, filename, width, height).

    An image that isn't there becomes a paragraph of its alternative text or caption in brackets, or goes where it has neither.
    """
    d = blocks.join(media.dropDuplicates(["src"]), "src", "left")
    missing = (F.col("kind") == "image") & F.col("filename").isNull()
    words = F.coalesce(F.nullif("alt", F.lit("")), F.nullif("caption", F.lit("")))
    made = F.concat(F.lit("<p><em>["), words, F.lit("]</em></p>"))
    d = d.where(~(missing & words.isNull())).withColumn("html", F.when(missing, made).otherwise(F.col("html")))
    return d.withColumn("tag", F.when(missing, "p").otherwise(F.col("tag"))).withColumn("kind", F.when(missing, "text").otherwise(F.col("kind")))


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link): distinct absolute targets of a page's anchors."""
    d = pages.select(key, url, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))).alias("rel"))
    return d.select(key, T.absolute_url(F.col(url), F.col("rel")).alias("link")).where("link IS NOT NULL").distinct()


def images(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, src, alt): the images of a page with absolute addresses, in order; src, else data-src; alt, else title."""
    d = pages.select(key, url, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)(<img\s[^>]*>)"), F.lit(1))).alias("pos", "tag"))
    attr = lambda k: F.nullif(F.regexp_extract("tag", rf"""(?i)\s{k}=["']([^"']*)["']""", 1), F.lit(""))
    return d.select(key, "pos", T.absolute_url(F.col(url), F.coalesce(attr("src"), attr("data-src"))).alias("src"), F.coalesce(attr("alt"), attr("title"), F.lit("")).alias("alt")).where("src IS NOT NULL")


def harvested(found: DataFrame, fetched: DataFrame, key: str = "page_id", most: int = 20) -> DataFrame:
    """found (key, pos, src, alt) with ``filename`` and ``text``: a page's first ``most`` images that could be fetched, numbered by their place.

    fetched (src, kind): what came back, kind png, jpeg, gif or webp (null or anything else: no use). Only successes count
    towards the limit. An image without a file is replaced by its alternative text in brackets, or by nothing.
    """
    good = fetched.where(F.col("kind").isin("png", "jpeg", "gif", "webp")).groupBy("src").agg(F.min("kind").alias("kind"))
    d = found.join(good, "src", "left")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__ok", F.col("kind").isNotNull()).withColumn("__n", F.sum(F.col("__ok").cast("int")).over(w))
    name = F.when(F.col("__ok") & (F.col("__n") <= most), F.concat(F.lit("img"), (F.col("pos") + 1).cast("string"), F.lit("."), "kind"))
    text = F.when(F.col("alt") != "", F.concat(F.lit("["), "alt", F.lit("]"))).otherwise("")
    return d.withColumn("filename", name).withColumn("text", F.when(F.col("filename").isNull(), text)).select(key, "pos", "src", "alt", "filename", "text")


def select_root(pages: DataFrame, selector: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) below the first element that a selector (tag, #id, .class, tag.class) names, else article, main, body."""
    import re

    m = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?", selector)
    if not selector or not m:
        raise ValueError(f"not a selector: {selector!r}")
    tag, kind, name = m.groups()
    d = html_tokens(pages, key, html)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.lit(True) if tag is None else F.col("tag") == tag.lower()
    if kind == "#":
        hit = hit & F.rlike("token", F.lit(rf"""(?i)\sid=["']?{name}["'\s>]"""))
    elif kind == ".":
        hit = hit & F.rlike("token", F.lit(rf"""(?i)\sclass=["'][^"']*\b{name}\b"""))
    opens = (F.col("tag") != "") & ~F.col("closing")
    rank = F.when(opens & hit, 0).when(opens & (F.col("tag") == "article"), 1).when(opens & (F.col("tag") == "main"), 2)
    roots = d.where(rank.isNotNull()).groupBy(key).agg(F.min(F.struct(rank.alias("r"), "pos", "tag")).alias("root"))
    d = d.join(roots, key, "left")
    same = (F.col("tag") == F.col("root.tag")) & (F.col("pos") >= F.col("root.pos"))
    d = d.withColumn("__d", F.sum(F.when(same & F.col("closing"), -1).when(same, 1).otherwise(0)).over(w))
    ended = F.max(F.when(same & F.col("closing") & (F.col("__d") <= 0), 1).otherwise(0)).over(w)
    d = d.withColumn("__e", ended)
    inside = F.col("root").isNull() | ((F.col("pos") >= F.col("root.pos")) & (F.col("__e") == 0))
    words = F.transform(F.array_sort(F.collect_list(F.when(inside & (F.col("tag") == ""), F.struct("pos", "token")))), lambda x: x["token"])
    return d.groupBy(key).agg(T.plain_text(F.array_join(words, " ")).alias("text"))


def fence_parity(lines: DataFrame, key: str = "documentid", no: str = "line_no", line: str = "line") -> DataFrame:
    """lines with ``in_code``: whether a line lies in a code fence (fence lines do too)."""
    w = Window.partitionBy(key).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    fence = F.rlike(line, F.lit(r"^\s*(```|~~~)"))
    return lines.withColumn("in_code", fence | (F.sum(fence.cast("int")).over(w) % 2 == 1))


def layout_segments(lines: DataFrame, key: str = "documentid", no: str = "line_no", line: str = "line") -> DataFrame:
    """lines with ``segment`` (from 0), cut at page breaks outside of code; break lines go."""
    d = fence_parity(lines, key, no, line)
    w = Window.partitionBy(key).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    breaks = ~F.col("in_code") & F.rlike(line, F.lit(r"^\s*(\{\{< pagebreak >\}\}|\\newpage|\\pagebreak)\s*$"))
    d = d.withColumn("__break", breaks).withColumn("__s", F.sum(breaks.cast("int")).over(w)).where("NOT __break")
    return d.withColumn("segment", (F.dense_rank().over(Window.partitionBy(key).orderBy("__s")) - 1).cast("long")).drop("__break", "__s")


def div_tree(lines: DataFrame, key: str = "documentid", no: str = "line_no", line: str = "line") -> DataFrame:
    """lines with ``depth`` and ``parent`` (line of the div around); closers at the root are ignored."""
    d = fence_parity(lines, key, no, line)
    w = Window.partitionBy(key).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    opens = ~F.col("in_code") & F.rlike(line, F.lit(r"^\s*:{3,}\s*\S"))
    closes = ~F.col("in_code") & F.rlike(line, F.lit(r"^\s*:{3,}\s*$"))
    d = d.withColumn("__o", opens).withColumn("__c", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    d = d.withColumn("depth", (F.col("__c") - F.least(F.lit(0), F.min("__c").over(w))).cast("long"))
    # the opener of the level around: for an opener one level up, for other lines their own level
    level = F.when(F.col("__o"), F.col("depth") - 1).otherwise(F.col("depth"))
    d = d.withColumn("__level", level)
    # openers and questions about a level meet in one window per level
    events = d.where("__o").select(key, F.col("depth").alias("__lv"), F.col(no).alias("__no"), F.col(no).alias("__open"))
    asked = d.select(key, F.col("__level").alias("__lv"), F.col(no).alias("__no"), F.lit(None).cast(d.schema[no].dataType).alias("__open"))
    v = Window.partitionBy(key, "__lv").orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(asked).withColumn("parent", F.last("__open", ignorenulls=True).over(v))
    parents = both.where("__open IS NULL").select(key, F.col("__no").alias(no), "parent")
    return d.join(parents, [key, no], "left").drop("__o", "__c", "__level", "in_code")


def markdown_blocks(lines: DataFrame, key: str = "documentid", no: str = "line_no", line: str = "line") -> DataFrame:
    """(key, block_index, tag, text): headings, paragraphs, lists, tables, code and page breaks of Markdown lines."""
    d = fence_parity(lines, key, no, line)
    c = F.col(line)
    rx = lambda p: F.rlike(c, F.lit(p))
    tag = (
        F.when(F.col("in_code"), "pre").when(rx(r"^\s*$"), "").when(rx(r"^\s*(\{\{< pagebreak >\}\}|\\newpage|\\pagebreak|<!-- pagebreak -->)\s*$"), "pagebreak")
        .when(rx(r"^#{1,6}\s"), F.concat(F.lit("h"), F.length(F.regexp_extract(c, r"^(#+)", 1)).cast("string"))).when(rx(r"^\s*[-*+]\s"), "ul").when(rx(r"^\s*\d+[.)]\s"), "ol")
        .when(rx(r"^\s*\|"), "table").when(rx(r"^\s*>"), "blockquote").otherwise("p")
    )
    w = Window.partitionBy(key).orderBy(no)
    d = d.withColumn("tag", tag)
    starts = (F.lag("tag").over(w).isNull()) | (F.col("tag") != F.lag("tag").over(w)) | F.rlike("tag", F.lit("^h[1-6]$|^pagebreak$"))
    d = d.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("tag <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(no, F.regexp_replace(c, r"^(#{1,6}\s+|\s*[-*+]\s+|\s*\d+[.)]\s+|\s*>\s?)", "").alias("t")))), lambda x: x["t"]), "\n")
    b = d.groupBy(key, "run", "tag").agg(text.alias("text"))
    return b.withColumn("block_index", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).drop("run")


def markdown_html(lines: DataFrame, key: str = "documentid", no: str = "line_no", line: str = "line") -> DataFrame:
    """(key, html) of Markdown lines: its blocks as elements, page breaks as hr, blocks of the margin (::: {.column-margin} or .aside, up to the next :::) in a div of that class.

    Marks inside of lines stay text. A margin block without an end is ordinary text, fences keep what looks like one. Sources without lines have no row.
    """
    d = fence_parity(lines, key, no, line)
    w = Window.partitionBy(key).orderBy(no)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    plain = ~F.col("in_code")
    opens = plain & F.rlike(line, F.lit(r"^:{3,}\s*\{\.(column-margin|aside)\}\s*$"))
    closes = plain & F.rlike(line, F.lit(r"^:{3,}\s*$"))
    d = d.withColumn("__o", opens).withColumn("__c", closes).withColumn("__end", F.coalesce(F.max(F.col("__c").cast("int")).over(ahead) == 1, F.lit(False)))
    event = F.when(F.col("__o") & F.col("__end"), 1).when(F.col("__c"), 0)
    d = d.withColumn("__in", F.coalesce(F.last(event, ignorenulls=True).over(back) == 1, F.lit(False)))
    edge = (F.col("__o") & F.col("__end") & ~F.col("__in")) | (F.col("__c") & F.col("__in"))
    d = d.withColumn("__edge", edge).withColumn("__part", F.sum(F.col("__edge").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__margin", F.col("__in") & ~F.col("__edge")).where("NOT __edge")
    parts = d.select(F.struct(key, "__part").alias("__k"), no, line, "__margin")
    b = markdown_blocks(parts, "__k", no, line).select(F.col(f"__k.{key}").alias(key), F.col("__k.__part").alias("__part"), "block_index", "tag", "text")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    element = lambda first, inner, last: F.concat(F.lit("<"), "tag", F.lit(">" + first), inner, F.lit(last + "</"), "tag", F.lit(">"))
    rows = F.filter(F.split(safe, "\n"), lambda r: ~F.rlike(r, F.lit(r"^[\s|:-]*$")))
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr><td>"), F.regexp_replace(F.regexp_replace(r, r"^\s*\|\s*|\s*\|\s*$", ""), r"\s*\|\s*", "</td><td>"), F.lit("</td></tr>")))
    code = F.array_join(F.filter(F.split(safe, "\n"), lambda r: ~F.rlike(r, F.lit(r"^\s*(```|~~~)"))), "\n")
    html = (
        F.when(F.col("tag") == "pagebreak", '<hr class="pagebreak">').when(F.col("tag").isin("ul", "ol"), element("<li>", F.replace(safe, F.lit("\n"), F.lit("</li><li>")), "</li>"))
        .when(F.col("tag") == "table", element("", F.array_join(cells, ""), "")).when(F.col("tag") == "pre", element("", code, "")).otherwise(element("", F.replace(safe, F.lit("\n"), F.lit(" ")), ""))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", html.alias("html")))), lambda x: x["html"]), "\n")
    pieces = b.groupBy(key, "__part").agg(joined.alias("html"))
    margins = d.groupBy(key, "__part").agg(F.bool_or("__margin").alias("__margin"))
    pieces = pieces.join(margins, [key, "__part"]).withColumn("html", F.when(F.col("__margin"), F.concat(F.lit('<div class="column-margin">'), "html", F.lit("</div>"))).otherwise(F.col("html")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "html"))), lambda x: x["html"]), "\n")
    return pieces.groupBy(key).agg(whole.alias("html"))


def note_numbers(blocks: DataFrame, key: str = "documentid") -> DataFrame:
    """blocks (key, block_index, numbered, text) with running note numbers; blocks without text hand their notes to the next text block, the last ones to the last."""
    w = Window.partitionBy(key).orderBy("block_index")
    d = blocks.withColumn("note_no", F.when(F.col("numbered"), F.sum(F.col("numbered").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    here = F.when(F.coalesce("text", F.lit("")) != "", F.col("block_index"))
    nxt = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("holder", F.coalesce(nxt, last))
