"""Registered queries of the library: each runs an operator over views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import ranges as R
from quire.functions import text as T
from quire.functions.tables import small_batches
from quire.operators import arrange as A
from quire.operators import blocks as B
from quire.operators import clips as C
from quire.operators import copies as C2
from quire.operators import flow as FL
from quire.operators import impose as I
from quire.operators import notes as N
from quire.operators import order as O
from quire.operators import overlay as V
from quire.operators import provenance as P
from quire.operators import publish as PU
from quire.operators import raster as RA
from quire.operators import transfer as TR
from quire.operators import typeset as TS
from quire.plans.fixtures import view, word_file, word_lines
from quire.sources import word as WD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")



def query(*views: str):
    """Registers a function of views under its own name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) if v.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views])

        QUERIES[f.__name__] = run
        return f

    return put


def rounded(c: str, places: int):
    """A double as SQL rounds it: its product with 10 ** places, a double itself, goes to the nearest whole number, halves away from zero. F.round would round the shortest decimal that stands for it."""
    return F.round(F.col(c) * 10.0**places) / 10.0**places


def text_of(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# sides and spreads
@query("fx_page", "fx_document")
def spreads(p, d):
    return O.spreads(O.rebalance(p, d)).select("documentid", "id", "position", "side", "row_no")


@query("fx_page", "fx_document")
def rebalance(p, d):
    b = A.arranged(p, d)
    return b.select("documentid", "position", "filler", F.coalesce("id", F.lit(0)).alias("id"))


@query("fx_page", "fx_document", "fx_overlay")
def rebalance_used_fillers(p, d, o):
    return O.rebalance(p, d, o).select("documentid", "id", "position", "blank_before")


@query("fx_page", "fx_document")
def layout_issues(p, d):
    return O.layout_issues(p, d)


@query("fx_page", "fx_document")
def issue_counts(p, d):
    return O.layout_issues(p, d).groupBy("documentid").agg(F.count("*").alias("issues"))


@query("fx_page")
def can_link(p):
    return O.can_link(p)


@query("fx_page")
def link_spreads(p):
    linked = O.link_spreads(p, p.select("id"))
    return linked.where("spreadid IS NOT NULL").select("id", "spreadid", "spreadside")


@query("fx_page", "fx_document")
def type_areas(p, d):
    placed = O.reading_order(p).join(d.select(F.col("id").alias("documentid"), "firstpageright"), "documentid")
    placed = placed.withColumn("side", G.side(F.col("position"), F.col("firstpageright"))).withColumn("a", G.type_area(F.col("side"), F.col("pagetype") == "html")).withColumn("n", G.note_area(F.col("side")))
    return placed.select("id", "side", *[F.round(F.col("a")[k], 6).alias(k) for k in "xywh"], F.round(F.col("n.x"), 6).alias("note_x"))


@query("fx_page")
def move_pages(p):
    first = p.where("NOT staged AND NOT (filler AND pagetype = 'canvas') AND sortorder = 3").select("documentid", "id", (F.col("documentid") % 2 == 0).alias("up"))
    return O.move_units(p, first)


@query("fx_page")
def adopt_pages(p):
    anchor = F.when(F.col("documentid") % 4 == 0, 0).when(F.col("documentid") % 4 == 1, F.col("documentid") * 100 + 2)
    return O.splice(p, p.where("staged").select("documentid", "id", anchor.cast("long").alias("anchor")))


@query("fx_page", "fx_document", "fx_overlay")
def mirror_overlays(p, d, o):
    side_set = F.when(F.col("sortorder") % 2 == 0, "left").when(F.col("sortorder") % 3 == 0, "right")
    return O.mirror_changed(o, p.withColumn("layoutside", side_set), d).select("id", "x")


@query("fx_page", "fx_document")
def import_preview(p, d):
    shown = O.import_preview(p, d, True)
    return shown.withColumns({"id": F.coalesce("id", F.lit(0)), "ghost": F.coalesce("ghost", F.lit("-"))})


@query("fx_page", "fx_document")
def flow_starts(p, d):
    return O.starts(p, d, True).select("documentid", "position", "shifted")


@query("fx_page")
def insert_blanks(p):
    commands = p.where("NOT staged AND sortorder IN (2, 5)").select("documentid", "id", (F.col("documentid") % 2 == 0).alias("before"))
    return O.insert_blanks(p, commands).select("documentid", F.coalesce("id", F.lit(0)).alias("id"), "position")


# ranges, excerpts, sheets
@query("fx_document", "fx_page")
def parse_range(d, p):
    n = p.where("NOT staged").groupBy(F.col("documentid").alias("id")).agg(F.count("*").alias("n"))
    r = d.join(n, "id").withColumn("numbers", R.parse_range(F.col("pagerange"), F.col("n")))
    return r.select("id", R.range_valid(F.col("pagerange")).alias("valid"), text_of("numbers"))


@query("fx_page", "fx_document")
def published_pages(p, d):
    return I.published_pages(p, d).select("documentid", "id", "pagenumber")


@query("fx_page", "fx_document")
def compact_range(p, d):
    return R.compact_range(I.published_pages(p, d), "documentid", "pagenumber")


@query("fx_page", "fx_document")
def print_selection(p, d):
    return I.print_selection(I.published_pages(p, d), "2-").select("documentid", "id", "position")


def _imposed(layout):
    def run(p, d):
        printed = I.print_selection(I.published_pages(p, d), "").select("documentid", "position", F.col("firstpageright").alias("startright"))
        return I.impose(printed, layout).select("documentid", "side_no", "slot_no", F.coalesce("position", F.lit(0)).alias("position"))

    run.__name__ = f"impose_{layout}"
    return run


for _layout in I.PER_SIDE:
    query("fx_page", "fx_document")(_imposed(_layout))


@query("fx_page", "fx_document")
def print_plan(p, d):
    return I.print_plan(p, d, "booklet").select("documentid", "side_no", "slot_no", "id", *[F.round(c, 2).alias(c) for c in "xywh"])


# provenance
@query("fx_page", "fx_source")
def citations(p, s):
    return P.page_citations(p, s)


@query("fx_page", "fx_source")
def source_counts(p, s):
    return P.source_counts(p, s)


@query("fx_document", "fx_page")
def master_usage(d, p):
    return P.master_usage(d, p)


@query("fx_document")
def lineage(d):
    return P.lineage(d)


@query("fx_document", "orders")
def copy_sources(d, orders):
    return P.copy_sources(d, orders.select((F.col("o_custkey") % 100).alias("userid"), (F.col("o_custkey") % 7).alias("course")))


@query("part", "fx_glossary")
def glossary_lookup(part, g):
    asked = part.select(F.col("p_size").alias("glossaryid"), F.upper("p_brand").alias("term"))
    return P.glossary_lookup(asked.unionByName(part.select(F.col("p_size").alias("glossaryid"), F.col("p_name").alias("term"))), g)


@query("fx_job")
def recent_jobs(j):
    return P.recent_jobs(j, now()).select("documentid", "id", "rank")


@query("fx_job")
def stale_jobs(j):
    return P.stale_jobs(j, now()).select("id")


@query("fx_job")
def job_result(j):
    files = j.select((F.col("documentid") % 500).alias("job"), F.col("id").alias("file_no"), F.when(F.col("status") == "failed", 0).otherwise(1).cast("long").alias("pages"), F.when(F.col("status") == "failed", F.concat(F.lit("bad "), F.col("id").cast("string"))).alias("error"))
    return P.job_result(files)


@query("fx_job")
def job_status(j):
    return P.job_status(j)


@query("fx_job")
def open_jobs(j):
    return P.open_jobs(j)


@query("fx_view")
def completion(v):
    return P.completion(v)


@query("fx_page")
def next_order(p):
    return P.next_order(p, "documentid", "sortorder")


# overlays
@query("fx_overlay")
def clamp_boxes(o):
    return V.clamped(o).select("id", *"xywh")


@query("fx_overlay")
def reading_order(o):
    return V.reading_order(o)


@query("fx_overlay")
def z_order(o):
    return V.z_order(o)


@query("fx_page", "fx_overlay")
def page_overlays(p, o):
    return V.page_overlays(p, o).select("id", text_of("overlays"))


@query("fx_page", "fx_overlay")
def page_facts(p, o):
    return V.page_facts(p, o)


@query("fx_overlay")
def column_numbers(o):
    return V.column_numbers(o)


@query("fx_overlay")
def learner_masks(o):
    settings = F.when(F.col("sortorder") % 3 == 0, '{"revealable":true}').when(F.col("sortorder") % 3 == 1, '{"style":"black"}').otherwise("{}")
    return V.mask_keys(o.withColumn("data", settings), o.select("pageid").distinct().withColumn("contenthash", F.sha1(F.col("pageid").cast("string"))))


# text
@query("pages")
def page_titles(p):
    return p.select("page_id", T.title(F.col("html")).alias("title"))


@query("pages")
def plain_text(p):
    return p.select("page_id", F.md5(T.plain_text(T.drop_active(T.body(F.col("html")))).cast("binary")).alias("text"))


@query("pages")
def previews(p):
    return p.select("page_id", T.preview(T.drop_active(T.body(F.col("html")))).alias("preview"))


@query("pages")
def html_tokens(p):
    return B.html_tokens(p).groupBy("page_id", "tag", "closing").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("pages")
def html_blocks(p):
    return B.html_blocks(p)


@query("pages")
def links_absolute(p):
    return B.links(p)


def _with_images(p):
    """Pages whose links to their own site are pictures."""
    return p.withColumn("html", F.regexp_replace("html", r'<a href="(/[^/"][^"]*)">([^<]*)</a>', '<img src="" data-src="$1" alt="$2">'))


@query("pages")
def images(p):
    return B.images(_with_images(p))


@query("pages")
def harvested_images(p):
    """At most four pictures of each page; of three addresses one brings nothing."""
    found = B.images(_with_images(p))
    kind = F.when(F.length("src") % 3 != 0, F.when(F.length("src") % 2 == 0, "png").otherwise("jpeg")).otherwise("html")
    return B.harvested(found, found.select("src", kind.alias("kind")).distinct(), most=4)


@query("pages")
def select_root(p):
    return B.select_root(p, "article")


@query("pages")
def charsets(p):
    return p.select("page_id", T.charset(F.lit(None).cast("string"), F.col("html")).alias("charset"))


@query("fx_line")
def layout_segments(x):
    return B.layout_segments(x).select("documentid", "line_no", "segment")


@query("fx_line")
def div_tree(x):
    return B.div_tree(x).select("documentid", "line_no", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("documents")
def markdown_blocks(d):
    lines = d.select(F.col("doc_id").alias("documentid"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return B.markdown_blocks(lines).groupBy("documentid", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("fx_line")
def note_numbers(x):
    blocks = x.select("documentid", F.col("line_no").alias("block_index"), F.startswith("line", F.lit(":::")).alias("numbered"), F.when(F.col("line_no") % 3 != 1, F.col("line")).otherwise("").alias("text"))
    return B.note_numbers(blocks).select("documentid", "block_index", F.coalesce("note_no", F.lit(0)).alias("note_no"), F.coalesce("holder", F.lit(-1)).cast("long").alias("holder"))


@query("part")
def column_widths(p):
    return p.select("p_partkey", T.snapped_width(F.col("p_size") * 2).alias("width"))


# flow
@query("documents")
def block_heights(d):
    b = FL.document_blocks(d)
    return b.select("doc_id", F.col("block_index").cast("long").alias("block_index"), FL.block_lines(F.col("tag"), F.col("text")).alias("lines"), F.round(FL.block_height(F.col("tag"), F.col("text")), 6).alias("h"))


@query("documents")
def line_breaks(d):
    ends = FL.line_breaks(F.col("text"), 80)
    return d.select("doc_id", F.size(ends).cast("long").alias("lines"), F.element_at(ends, 1).cast("long").alias("first_end"), F.element_at(ends, -1).cast("long").alias("last_end"))


@query("documents")
def flow_pages(d):
    return TS.typeset(TS.html_documents(d)).drop("html")


def pictured(d):
    """Blocks of documents with a picture behind each fifth and a note beside each third."""
    b = TS.html_documents(d).withColumn("block_index", F.col("block_index") * 2)
    pixels = F.length("html")
    pictures = b.where("block_index % 5 = 0").select("doc_id", (F.col("block_index") + 1).alias("block_index"), F.lit("image").alias("kind"), (pixels * 7 % 1500 + 40).alias("width"), (pixels * 3 % 900 + 20).alias("height"), F.substring(F.regexp_replace("html", "<[^>]*>", ""), 1, 12).alias("caption"))
    beside = F.when(F.col("block_index") % 3 == 0, F.array(F.concat(F.lit("<p>"), F.substring(F.regexp_replace("html", "<[^>]*>|&", ""), 1, 200), F.lit("</p>")), F.lit("<p>b</p>")))
    return b.withColumn("notes", beside).unionByName(pictures, True)


@query("documents")
def flow_images(d):
    return TS.typeset(pictured(d), notes=True).drop("html")


@query("part")
def natural_frames(p):
    f = FL.natural_frame(F.col("p_size") * 40, F.col("p_partkey") % 3000, F.lit(FL.TEXT_W), F.lit(FL.AREA_BOTTOM - FL.AREA_TOP))
    return p.select("p_partkey", F.round(f["w"], 6).alias("w"), F.round(f["h"], 6).alias("h"))


@query("documents")
def flow_frames(d):
    return TS.frames(TS.typeset(pictured(d)))


@query("documents")
def flow_map(d):
    return TS.flow_map(TS.typeset(pictured(d), notes=True)).select("doc_id", "page_no", text_of("blocks"))


@query("documents")
def flow_text_kept(d):
    """Characters besides blanks of each document that stand in frames."""
    inner = F.regexp_replace("html", "<[^>]*>|[ \t\r\f]+", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(entity), F.lit(sign))
    return TS.typeset(TS.html_documents(d)).groupBy("doc_id").agg(F.sum(F.length(inner)).alias("characters"))


@query("documents", "fx_document")
def flowed_pages(d, f):
    """Pages of documents that begin on the right, after the pages that are there."""
    starts = f.select(F.expr("id % 1000").alias("doc_id"), (F.expr("id % 7") + 1).alias("start"), "firstpageright").groupBy("doc_id").agg(F.max("start").alias("start"), F.bool_or("firstpageright").alias("firstright"))
    pages = TS.page_rows(TS.typeset(TS.html_documents(d), starts=starts, startright=True), startright=True)
    return TS.with_fillers(pages, starts)


@query("documents")
def markup_cuts(d):
    """Documents' first lines with a mark-up by word, cut at a budget."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", r"[<>&\n\r\t\f]+", " "), " +", " ")), " ")
    marked = F.transform(words, lambda w, i: F.when(i % 7 == 3, F.concat(F.lit("<b>"), w, F.lit(" "), w, F.lit("</b>"))).when(i % 11 == 5, F.concat(F.lit("<em><a href='#x'>"), w, F.lit("</a></em>"))).otherwise(w))
    made = d.select("doc_id", F.concat(F.lit("<p>"), F.array_join(marked, " "), F.lit("</p>")).alias("html"), (F.col("doc_id") % 300 + 15).alias("budget"))
    small_batches(d.sparkSession)  # a text and its cuts, not ten thousand of them
    return made.select("doc_id", TS.split_markup(F.col("html"), F.col("budget")).alias("x")).select("doc_id", "x.head", F.length("x.tail").alias("left"))


@query("documents")
def noted_blocks(d):
    """Documents as HTML with notes of all kinds between and in their lines."""
    lines = word_lines(F.col("text"))
    def piece(x, i):
        n = i.cast("string")
        join = lambda t: F.concat(*[x if c == "L" else n if c == "N" else F.lit(c) for c in t])
        return (
            F.when(i % 5 == 0, join(("<p>", "L", "</p>"))).when(i % 5 == 1, join(("<p>", "L", "<label class='margin-toggle'>+</label><span class=\"wide sidenote\">side ", "N", " <b>mark</b></span> end</p>\n")))
            .when(i % 5 == 2, join(("<p>", "L", "</p>\n<aside><ul><li>", "L", "</li><li>two<ul><li>deep</li></ul></li></ul></aside>")))
            .when(i % 5 == 3, join(("<p>", "L", "<sup><a href=\"#fn:", "N", "\">x</a></sup></p>"))).otherwise(join(("<div><span class='marginnote'>m ", "N", "</span></div><blockquote>", "L", "</blockquote>")))
        )
    foot = lambda x, i: F.when(i % 5 == 3, F.concat(F.lit('<li id="fn:'), i.cast("string"), F.lit('"><p>foot '), i.cast("string"), F.lit("</p><ol><li>"), x, F.lit('</li></ol> <a class="footnote-back" href="#y">back</a></li>'))).otherwise("")
    html = F.concat(F.array_join(F.transform("lines", piece), ""), F.lit('<section class="footnotes"><ol>'), F.array_join(F.transform("lines", foot), ""), F.lit("</ol></section>"))
    pages = d.select("doc_id", lines.alias("lines")).select("doc_id", html.alias("html"))
    return N.noted_blocks(pages, "doc_id").select("doc_id", F.col("block_index").cast("long").alias("block_index"), "kind", "tag", "html", F.array_join("notes", "|").alias("notes"))


def word_documents(d):
    return WD.word_parts(d.select(F.col("doc_id").cast("string").alias("path"), word_file(word_lines(F.coalesce("text", F.lit("")))).alias("content")))


@query("documents")
def word_pages(d):
    """Pages of Word documents that are made from the documents' lines."""
    return WD.word_pages(word_documents(d)).select(F.col("path").cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), "html")


@query("documents")
def word_media(d):
    """Pictures of the same Word documents, by relation."""
    return WD.word_media(word_documents(d)).select(F.col("path").cast("long").alias("doc_id"), "id", "src", "filename", F.decode("data", "utf-8").alias("data"))


@query("documents", "part")
def pictured_blocks(d, p):
    """Documents as HTML with figures, pictures and page breaks between their lines; pictures are named after parts, and each third isn't there."""
    lines = word_lines(F.col("text"))
    n = lambda i: i.cast("string")
    piece = lambda x, i: (
        F.when(i % 4 == 0, F.concat(F.lit("<p>"), x, F.lit("<img src='p"), n(i), F.lit(".png' alt=\"A\"> more</p>"))).when(i % 4 == 1, F.concat(F.lit("<figure><picture><img alt='' src=\"p"), n(i), F.lit('.png"></picture><figcaption>'), x, F.lit("</figcaption></figure>")))
        .when(i % 4 == 2, F.concat(F.lit("<hr class='pagebreak'>"), x, F.lit("<hr>"))).otherwise(F.concat(F.lit("<figure><figcaption>"), x, F.lit("</figcaption></figure>")))
    )
    pages = d.select("doc_id", F.array_join(F.transform(lines, piece), "").alias("html"))
    k = F.col("p_partkey").cast("string")
    media = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), k, F.lit(".png")).alias("src"), F.concat(F.lit("f"), k).alias("filename"), F.col("p_size").cast("long").alias("width"), F.lit(50).alias("height"))
    found = B.resolved_images(B.import_blocks(pages, "doc_id"), media, "doc_id")
    return found.select("doc_id", F.col("block_index").cast("long").alias("block_index"), "kind", "tag", "html", "src", "caption", "filename", "width")


@query("fx_overlay")
def note_tops(o):
    notes = o.select(F.col("pageid").alias("page"), F.col("id").alias("no"), F.col("y").cast("double").alias("y"), (F.col("w") / 10).cast("double").alias("h"))
    return FL.note_tops(notes).select("page", "no", F.round("top", 6).alias("top"))


# transfer
@query("fx_document", "fx_page", "fx_overlay")
def export_nested(d, p, o):
    n = TR.export_nested(d, p, o)
    return n.select("id", F.array_join(F.transform("pages", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.array_join(F.transform(x["overlays"], lambda y: y["id"].cast("string")), "+"))), ",").alias("pages"))


@query("fx_document", "fx_page", "fx_overlay")
def nested_round_trip(d, p, o):
    pages, overlays = TR.import_nested(TR.export_nested(d, p, o), 10**9)
    return pages.select("documentid", "id", F.lit("page").alias("kind")).unionByName(overlays.select(F.col("pageid").alias("documentid"), "id", F.lit("overlay").alias("kind")))


@query("fx_document", "fx_page")
def copy_pages(d, p):
    made = d.where("masterid IS NOT NULL").select(F.col("id").alias("target"), "masterid")
    return TR.copy_pages(I.published_pages(p, d), made).select("documentid", "id", "copied_from", F.coalesce("spreadid", F.lit(0)).alias("spreadid"))


@query("fx_document")
def remap_masters(d):
    return TR.without_lost_masters(d).select("id", F.coalesce("masterid", F.lit(0)).alias("masterid"))


@query("fx_page")
def broken_spreads(p):
    return TR.broken_spreads(p.where("NOT staged"))


@query("fx_document", "fx_page", "fx_overlay")
def orphans(d, p, o):
    lost = lambda c, n: F.when(F.col("id") % n == 0, -F.col(c)).otherwise(F.col(c))  # noqa: E731  some keys lead nowhere
    return TR.orphans(d, p.withColumn("documentid", lost("documentid", 11)), o.withColumn("pageid", lost("pageid", 9)))


@query("fx_page", "fx_source")
def delete_sources(p, s):
    return TR.delete_sources(p, s.where("id % 4 = 0")).select("id", F.coalesce("sourceid", F.lit(0)).alias("sourceid"))


@query("fx_document", "fx_page", "fx_overlay")
def delete_documents(d, p, o):
    gone = d.where("ismaster").select("id")
    docs, pages, overlays = TR.delete_documents(gone, d, p, o)
    return docs.select("id", F.lit("document").alias("kind")).unionByName(pages.select("id", F.lit("page").alias("kind"))).unionByName(overlays.select("id", F.lit("overlay").alias("kind")))


# raster: profiles of embeddings, character grids of documents
def _profiles(e):
    return e.select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("x", "v")).select("page", F.col("x").cast("long").alias("x"), F.round(F.abs("v").cast("double"), 6).alias("ink"))


@query("embeddings")
def empty_band(e):
    return RA.empty_band(_profiles(e), 0.05)


@query("embeddings")
def shadow_valley(e):
    return RA.shadow_valley(_profiles(e).withColumn("lum", F.round(F.col("ink") * 1000).cast("long")), 25)


@query("embeddings")
def text_columns(e):
    return RA.text_columns(_profiles(e), 0.08)


@query("embeddings")
def border_box(e):
    return RA.border_box(_profiles(e), "x", 0.1)


def _cells(d, *more):
    lines = d.select(F.col("doc_id").alias("page"), *more, F.posexplode(F.split("text", "\n")).alias("y", "line"))
    return lines.where("line <> ''").select("page", *more, F.col("y").cast("long").alias("y"), F.posexplode(F.split("line", "")).alias("x", "c")).select("page", *more, "y", F.col("x").cast("long").alias("x"), F.when(F.col("c") == " ", 255).otherwise(0).alias("lum"))


@query("documents")
def row_profile(d):
    return RA.row_profile(_cells(d)).select("page", "y", rounded("ink", 6).alias("ink"))


# publishing
@query("fx_page", "fx_document")
def visible_pages(p, d):
    grants = d.select((F.col("id") % 10).alias("userid"), F.col("id").alias("documentid"), (F.col("id") % 3 == 0).alias("edit"), (F.col("id") % 2 == 0).alias("viewsolutions"))
    return PU.visible_pages(p, d, grants)


@query("fx_line")
def layout_pages(x):
    return PU.layout_pages(x)


@query("documents")
def split_passages(d):
    s = d.select("doc_id", T.split_text(F.replace("text", F.lit("\n"), F.lit(" ")), 200).alias("s"))
    return s.select("doc_id", "s.head", F.length("s.tail").alias("rest"))


@query("part", "orders")
def image_texts(part, orders):
    refs = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("alt"), F.col("p_name").alias("caption"))
    return PU.image_texts(refs, orders.select((F.col("o_orderkey") * 2).alias("src"))).select("id", "found", F.coalesce("fallback", F.lit("-")).alias("fallback"))


# clips, notes and images of imported text
def _clips(p):
    return p.select("documentid", F.when(F.col("sortorder") % 3 == 0, F.concat(F.lit("bild"), F.col("sortorder").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("ausschnitt-"), F.col("sortorder").cast("string"), F.lit(".png"))).alias("filename"))


@query("fx_page")
def next_clip(p):
    return C.next_clip(_clips(p))


@query("fx_document", "fx_page")
def missing_clips(d, p):
    made = d.where("masterid IS NOT NULL").select(F.col("id").alias("target"), "masterid")
    return C.missing_clips(_clips(p), _clips(p.where("NOT staged")), made)


@query("fx_source", "part")
def snippet_images(s, part):
    refs = s.select(F.col("id").alias("sourceid"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("@@PLUGINFILE@@/"), F.replace("filename", F.lit("e"), F.lit("%65")))).otherwise(F.col("filename")).alias("src"))
    files = part.select(F.col("p_partkey").alias("sourceid"), F.concat(F.lit("file"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("filename")).where("sourceid % 3 <> 0")
    return C.snippet_images(refs, files).select("sourceid", F.coalesce("filename", F.lit("-")).alias("filename"))


@query("fx_page")
def layout_images(p):
    src = F.when(F.col("sortorder") % 4 == 0, F.concat(F.lit("HTTPS://x.test/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("ausschnitt-"), (F.col("sortorder") * 2).cast("string"), F.lit(".png")))
    refs = p.select("id", "documentid", src.alias("src"), F.when(F.col("id") % 2 == 0, F.col("pagetype")).alias("alt"))
    return C.layout_images(refs, _clips(p)).select("id", F.coalesce("url", F.lit("-")).alias("url"), F.coalesce("fallback", F.lit("-")).alias("fallback"))


@query("fx_overlay", "fx_glossary")
def remap_glossaries(o, g):
    glossaries = g.select(F.col("glossaryid").alias("id"), (F.col("glossaryid") % 7).alias("course")).distinct()
    mapping = glossaries.where("id % 5 = 1").select(F.col("id").alias("old"), (F.col("id") + 1000).alias("new"))
    rows = o.where("overlaytype = 'glossary'").select("id", (F.col("pageid") % 7).cast("int").alias("course"), (F.col("id") % 60).cast("int").alias("glossaryid"))
    return C.remap_glossaries(rows, mapping, glossaries).select("id", F.col("glossaryid").cast("long").alias("glossaryid"))


@query("documents")
def hidden_passages(d):
    b = FL.document_blocks(d).withColumnRenamed("doc_id", "sourceid")
    return C.hidden_passages(b, b.where("length(text) % 4 = 0"))


@query("orders")
def footnotes(o):
    n = F.col("o_orderkey").cast("string")
    html = F.concat(F.lit("<p>a<sup><a class='r' href=\"#fn:1\">1</a></sup> b<a href='#fn"), n, F.lit("'>x</a></p><ol class='footnotes'><li id=\"fn:1\"> <em>"), "o_orderpriority", F.lit("</em>\n<a href='#fnref:1'>back</a></li><li id='fn"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).cast("string"), F.lit("'>two</li></ol>"))
    return C.footnotes(o.select("o_orderkey", html.alias("html")), "o_orderkey")


@query("part")
def writing_lines(p):
    asked = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, "many").otherwise((F.col("p_size") * 2 - 20).cast("string"))
    return p.select("p_partkey", C.writing_lines(asked).cast("int").alias("lines"), F.array_join(C.safe_classes(F.split(F.concat(F.lit("box 2x a_b "), "p_brand"), " ")), " ").alias("classes"))


@query("fx_source")
def stale_measures(s):
    then = s.select(F.col("id").alias("sourceid"), F.col("sourcetype").alias("fonts"), F.lit("tufte").alias("style"), F.lit(1.5).alias("geometry"))
    now_ = then.withColumn("fonts", F.when(F.col("sourceid") % 3 == 0, "serif").otherwise(F.col("fonts"))).where("sourceid % 8 <> 1")
    return C.stale_measures(then, now_)


@query("documents")
def mean_luminance(d):
    lines = F.split("text", "\n")
    sizes = d.select("doc_id", F.array_max(F.transform(lines, lambda x: F.size(F.split(x, "")))).alias("width"), F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i + 1))).alias("height")).where("height IS NOT NULL")
    sizes = sizes.groupBy("doc_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return C.mean_luminance(_cells(d.join(sizes, "doc_id"), "width", "height")).select("page", rounded("mean", 4).alias("mean"), "invert")


# edits of page order with what follows from them
def _sided(p):
    return p.withColumn("layoutside", F.expr("CASE WHEN sortorder % 2 = 0 THEN 'left' WHEN sortorder % 3 = 0 THEN 'right' END"))


def _shown(d):
    return d.select("documentid", F.coalesce("id", F.lit(0)).alias("id"), "position", "filler", F.coalesce("spreadid", F.lit(0)).alias("spreadid"), "turned")


@query("fx_page", "fx_document", "fx_overlay")
def arranged(p, d, o):
    return _shown(A.arranged(_sided(p), d, o))


@query("fx_page", "fx_document", "fx_overlay")
def adopted_pages(p, d, o):
    """Staged pages but each fifth go behind a page, to the start or to the end."""
    anchor = F.expr("CASE WHEN documentid % 4 = 0 THEN 0 WHEN documentid % 4 = 1 THEN documentid * 100 + 2 END")
    return _shown(A.adopt(_sided(p), d, p.where("staged AND id % 5 <> 0").select("documentid", "id", anchor.alias("anchor")), o))


@query("fx_page", "fx_document", "fx_overlay")
def inserted_pages(p, d, o):
    return _shown(A.insert(_sided(p), d, d.select(F.col("id").alias("documentid"), (F.col("id") * 100 + 1 + F.col("id") % 3).alias("id"), (F.col("id") % 2 == 0).alias("before")), o))


@query("fx_page", "fx_document", "fx_overlay")
def linked_pages(p, d, o):
    return _shown(A.link(_sided(p), d, d.select(F.col("id").alias("documentid"), (F.col("id") * 100 + 1 + F.col("id") % 3).alias("id")), o))


@query("fx_page", "fx_document", "fx_overlay")
def turned_overlays(p, d, o):
    return A.turned_overlays(o, A.arranged(_sided(p), d, o)).select("id", "pageid", "x")


# whole copies
FIRST = {"document": 10**9, "source": 2 * 10**9, "page": 3 * 10**9, "overlay": 4 * 10**9}


def _whole(d, p, o):
    """Tables whose sources belong to their documents, with flow maps that also name a page that isn't there."""
    p = p.withColumn("sourceid", F.col("documentid") * 100_000 + F.col("sourceid"))
    s = p.groupBy("documentid", F.col("sourceid").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("id", F.array(F.col("sortorder").cast("int")).alias("b")))).alias("flowmap"))
    s = s.withColumn("flowmap", F.map_concat("flowmap", F.create_map(F.lit(7).cast("long"), F.array(F.lit(1)))))
    return {"document": d, "source": s, "page": p, "overlay": o}


def _copies(d, p, o):
    commands = d.where("masterid IS NOT NULL").select(F.col("id").alias("target"), "masterid", F.expr("CASE id % 3 WHEN 0 THEN '2-3' WHEN 1 THEN '' ELSE '1,3-' END").alias("range"))
    tables = _whole(d, p, o)
    return tables, C2.copied(tables, commands, FIRST)


@query("fx_document", "fx_page", "fx_overlay")
def copied_pages(d, p, o):
    made = _copies(d, p, o)[1]["page"]
    return made.select("documentid", "id", F.col("sortorder").cast("long").alias("sortorder"), "copied_from", "sourceid", F.coalesce("spreadid", F.lit(0)).alias("spreadid"))


@query("fx_document", "fx_page", "fx_overlay")
def copied_rows(d, p, o):
    made = _copies(d, p, o)[1]
    rows = made["source"].select("id", "documentid", "copied_from", F.lit("source").alias("kind")).unionByName(made["overlay"].select("id", F.col("pageid").alias("documentid"), "copied_from", F.lit("overlay").alias("kind")))
    return rows.unionByName(made["document"].select("id", F.col("masterid").alias("documentid"), F.length("masterrange").cast("long").alias("copied_from"), F.lit("document").alias("kind")))


@query("fx_document", "fx_page", "fx_overlay")
def copies_balanced(d, p, o):
    return _shown(C2.with_copies(*_copies(d, _sided(p), o)))


def _restored(d, p, o):
    return C2.restored(C2.tables_of(C2.export_whole(*_whole(d, p, o).values())), FIRST, d.where("id % 2 = 0"))


@query("fx_document", "fx_page", "fx_overlay")
def restored_pages(d, p, o):
    lost = F.when((F.col("sortorder") == 1) & (F.col("documentid") % 5 == 0), 7).otherwise(F.col("spreadid"))
    return _restored(d, p.withColumn("spreadid", lost.cast("long")), o)["page"].select("documentid", "id", "sourceid", F.coalesce("spreadid", F.lit(0)).alias("spreadid"), F.coalesce("spreadside", F.lit("")).alias("spreadside"))


@query("fx_document", "fx_page", "fx_overlay")
def restored_sources(d, p, o):
    entries = F.transform(F.array_sort(F.map_entries("flowmap")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"][0].cast("string")))
    return _restored(d, p, o)["source"].select("id", "documentid", F.array_join(entries, ",").alias("flowmap"))


@query("fx_document", "fx_page", "fx_overlay")
def restored_rows(d, p, o):
    made = _restored(d, p, o)
    return made["document"].select("id", F.coalesce("masterid", F.lit(0)).alias("parent"), F.lit("document").alias("kind")).unionByName(made["overlay"].select("id", F.col("pageid").alias("parent"), F.lit("overlay").alias("kind")))


@query("fx_document", "fx_page", "fx_overlay", "fx_source", "fx_job")
def deleted_rows(d, p, o, s, j):
    """What is left of all tables after masters went, jobs and sources included."""
    s = s.select("id", (F.col("id") * 4).alias("documentid"))
    left = C2.deleted({"document": d, "source": s, "page": p, "overlay": o, "job": j}, d.where("ismaster"))
    return left["document"].select("id", F.lit("document").alias("kind")).unionByName(left["source"].select("id", F.lit("source").alias("kind"))).unionByName(left["page"].select("id", F.lit("page").alias("kind"))).unionByName(left["overlay"].select("id", F.lit("overlay").alias("kind"))).unionByName(left["job"].select("id", F.lit("job").alias("kind")))


@query("fx_page", "fx_overlay")
def without_pages(p, o):
    left = C2.without_pages({"page": p, "overlay": o}, p.where("id % 7 = 0"))
    return left["page"].select("id", F.coalesce("spreadid", F.lit(0)).alias("spreadid"), F.lit("page").alias("kind")).unionByName(left["overlay"].select("id", F.lit(0).cast("long").alias("spreadid"), F.lit("overlay").alias("kind")))


# jobs and citations
@query("fx_job")
def listed_jobs(j):
    return P.listed_jobs(j, j.where("id % 3 = 0"), now()).select("id", "status")


@query("fx_document", "fx_page")
def copy_sources_of(d, p):
    """Masters that a user (of a course) may copy from into a document of theirs."""
    grants = d.select((F.col("course") % 7).alias("userid"), "course").distinct()
    return P.copy_sources(d, grants, d.where("id % 500 = 0").select((F.col("course") % 7).alias("userid"), F.col("id").alias("documentid")))


@query("fx_source")
def printed_citations(s):
    accessed = F.timestamp_seconds(F.col("id") * 86400)
    return s.select("id", P.printed_citation(accessed=accessed).alias("citation"))


@query("documents")
def shown_blocks(d):
    b = pictured(d).withColumn("filename", F.when(F.col("block_index") % 3 == 0, "a.png"))
    kept = TS.shown_blocks(b, b.where("kind = 'text' AND block_index % 8 = 2").select("doc_id", "block_index"), b.where("doc_id % 4 = 0 AND block_index = 0").select("doc_id", "block_index"))
    return kept.select("doc_id", F.col("block_index").cast("long").alias("block_index"), "kind")


# publishing settings, cleanup, columns
@query("fx_document")
def publish_settings(d):
    asked = F.expr("CASE id % 4 WHEN 0 THEN '  2-3 ' WHEN 1 THEN '3-1' WHEN 2 THEN '' END")
    changes = d.where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 33 == 0, 10**9).otherwise(0)).alias("id"), asked.alias("pagerange"), F.expr("CASE WHEN id % 2 = 0 THEN NOT ismaster END").alias("ismaster"))
    docs, rejected = PU.publish_settings(d, changes, now())
    return docs.select("id", "pagerange", "ismaster", F.lit("").alias("message")).unionByName(rejected.select("id", "pagerange", "ismaster", "message"))


@query("fx_document")
def course_documents(d):
    return PU.course_documents(d, d.where("id % 1000 = 3").select("course")).select("id", "course")


@query("fx_page")
def cleaned_pages(p):
    g = p.where("id % 3 <> 0").select("id", (F.col("width") * 0.5).cast("long").alias("x"))
    return RA.cleaned_pages(p.where("NOT staged"), g).select("documentid", "id", "half", "width", "landscapelock", F.coalesce("spreadid", F.lit(0)).alias("spreadid"), "new")


@query("embeddings")
def column_boxes(e):
    profile = _profiles(e)
    columns = RA.text_columns(profile, 0.08).withColumn("width", F.lit(64))
    boxes = RA.column_boxes(columns, profile.select("page", F.col("x").alias("y"), F.when(F.col("ink") > 0.2, F.col("ink")).otherwise(0.0).alias("ink")))
    return boxes.select("page", F.col("column_no").cast("long").alias("column_no"), *[F.round(c, 6).alias(c) for c in "xywh"])


@query("fx_page", "fx_document")
def print_plan_1up(p, d):
    return I.print_plan(p, d, "1up").select("documentid", "id", *"xywh")


@query("fx_page", "fx_document", "fx_overlay", "fx_source")
def print_items(p, d, o, s):
    items = I.print_items(p, d, o, s, "1up")
    return items.select("documentid", "side_no", "pageid", F.col("z").cast("long").alias("z"), "kind", F.coalesce("overlayid", F.lit(0)).alias("overlayid"), *[F.round(c, 4).alias(c) for c in "xywh"], F.coalesce("text", F.lit("")).alias("text"))


@query("fx_page", "fx_line")
def updated_layout(p, x):
    pages = p.withColumn("content", F.concat(F.lit("p"), F.col("id").cast("string")))
    ids = p.where("sortorder = 1 AND NOT staged AND documentid <= 300").select(F.col("documentid"), "id")
    lines = x.join(ids, "documentid").select(F.col("id").alias("pageid"), "line_no", "line")
    return PU.updated_layout(pages, lines).select("documentid", F.coalesce("id", F.lit(0)).alias("id"), "part", "content", "position")


@query("fx_page", "fx_overlay")
def documents_with_text(p, o):
    return V.documents_with_text(p, o)


@query("fx_page", "fx_source")
def import_area(p, s):
    return O.import_area(p, s.where("id % 20 = 0").select("id")).select("documentid", "id", "position")


@query("fx_page")
def pins_and_unlinks(p):
    """Spreads of each sixth document are dissolved, then pins are set: right, none, or a side that doesn't exist."""
    free = O.unlink(p, p.where("documentid % 6 = 0 AND spreadid IS NOT NULL").select("spreadid"))
    pins = p.where("id % 4 = 0").select("id", F.expr("CASE id % 3 WHEN 0 THEN 'right' WHEN 1 THEN 'up' END").alias("pin"))
    return O.set_pins(free, pins).select("id", F.coalesce("spreadid", F.lit(0)).alias("spreadid"), F.coalesce("pinside", F.lit("")).alias("pinside"))


@query("fx_page")
def adopted_blocks(p):
    """Passages on pages that are taken over and on none that stays in the import area."""
    flowmap = p.select("sourceid", F.col("id").alias("pageid"), F.explode(F.array(F.col("sortorder"), F.col("sortorder") + 1)).alias("block_index"))
    found = FL.adopted_blocks(flowmap, p.where("id % 3 = 0").select("id"), p.where("id % 3 = 1").select("id"))
    return found.select("sourceid", F.col("block_index").cast("long").alias("block_index"))


@query("lineitem")
def clean_measures(x):
    m = x.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 4 - 1).alias("h"), (F.col("l_tax") - 0.04).alias("lh"), F.sequence(F.lit(1), (F.col("l_quantity") * 200).cast("int")).alias("lines"))
    return FL.clean_measures(m.where("l_orderkey % 50 = 0")).groupBy(F.col("l_linenumber").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("h"), 4).alias("h"), F.round(F.sum("lh"), 4).alias("lh"), F.sum(F.size("lines")).alias("lines"))


@query("fx_source")
def cleanup_options(s):
    from quire.sources.scan import cleanup_options as options

    asked = F.expr("filter(array('split', CASE WHEN id % 2 = 0 THEN 'chop' END, CASE WHEN id % 3 = 0 THEN 'deskew' END, 'paint', 'shadow'), x -> x IS NOT NULL)")
    return s.select("id", F.array_join(options(asked, F.when(F.col("id") % 5 == 0, "cbz").otherwise(F.col("sourcetype"))), ",").alias("options"))


@query("embeddings")
def paper_means(e):
    samples = e.select(F.col("vec_id").alias("box"), F.posexplode("embedding").alias("no", "v")).select("box", "no", F.floor(F.abs(F.col("v").cast("double")) * 500).alias("lum"))
    return RA.paper_mean(samples).select("box", rounded("lum", 6).alias("lum"))


@query("part")
def luminances(p):
    return p.select("p_partkey", RA.luminance(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256).alias("lum"))


@query("fx_source")
def changed_sources(s):
    changes = s.where("id % 2 = 0").select("id", F.expr("CASE WHEN id % 4 = 0 THEN 'New' END").alias("title"), F.expr("CASE WHEN id % 6 = 0 THEN '' END").alias("author"))
    return P.changed(s, changes).select("id", "title", "author", "filename")


@query("fx_source")
def recorded_sources(s):
    from quire.sources.catalog import record_sources

    long = s.select((F.col("id") % 9).alias("documentid"), "sourcetype", F.repeat(F.concat(F.lit(" "), "title"), 90).alias("title"), "url", F.repeat("author", 20).alias("author"), F.concat(F.lit("  "), "filename", F.lit(" ")).alias("filename"))
    return record_sources(long)


@query("part")
def passage_kinds(p):
    tag = F.element_at(F.lit(["p", "h1", "h6", "h7", "ul", "ol", "table", "img", "image", "pre"]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return p.select("p_partkey", T.passage_kind(tag).alias("kind"))


@query("fx_overlay", "fx_page")
def clip_rects(o, p):
    box = G.clip_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return o.join(p.select(F.col("id").alias("pageid"), "width", "height"), "pageid").select("id", box["left"].alias("px"), box["top"].alias("py"), box["width"].alias("width"), box["height"].alias("height"))


@query("part")
def fitted_images(p):
    box = G.fit_image(F.lit(0.5), F.lit(0.25), F.col("p_size") * 1.0, F.col("p_partkey") % 40 + 1.0, F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", *[F.round(box[c], 6).alias(c) for c in "xywh"])


@query("fx_overlay")
def overset_frames(o):
    frames = o.where("overlaytype = 'textframe'").select("id", F.col("h").cast("double").alias("h"), (F.col("id") % 17 / 100.0).alias("needed"))
    return V.overset(frames).select("id", F.round("missing", 6).alias("missing"))


@query("fx_overlay")
def appended_overlays(o):
    from quire.sources.catalog import appended

    new = o.where("id % 5 = 0").select("id", F.col("pageid").alias("pageid"))
    return appended(new, o.where("id % 5 <> 0"), "pageid").select("id", "pageid", F.col("sortorder").cast("long").alias("sortorder"))


@query("embeddings")
def skews(e):
    """Angles of point clouds: the larger components of vectors as points of a line of text."""
    v = e.select("vec_id", F.posexplode("embedding").alias("x", "v")).where("abs(v) > 0.02")
    points = v.select((F.col("vec_id") % 97).alias("page"), (F.col("x") * 5 + F.col("vec_id") % 5).alias("x"), (F.floor(F.col("vec_id") / 97) * 3 + F.floor(F.col("x") * F.col("vec_id") % 97 / 30)).alias("y"))
    return RA.skew(points)


@query("documents")
def shadows(d):
    """Pages whose letters lie on an uneven background: what each row of characters sums up to without the shadow."""
    lines = d.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("y", "line"))
    rows = lines.select("page", "y", F.transform(F.sequence(F.lit(0), F.size(F.split("line", "")) - 1), lambda x: 60 + (x * 7 + F.col("y") * 13) % 150).alias("lum"))
    flat = RA.rows_without_shadow(rows, 16)
    total = F.aggregate("lum", F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.groupBy("page").agg(F.sum(F.size("lum")).alias("pixels"), F.sum(total).alias("lum"))


@query("documents")
def html_heights(d):
    """Estimated heights of documents' lines as headings, paragraphs, lists, tables and preformatted text by turns."""
    lines = d.select("doc_id", F.posexplode(word_lines(F.col("text"))).alias("i", "l"))
    put = lambda *parts: F.concat(*[F.col("l") if x == "L" else F.lit(x) for x in parts])
    tag = F.element_at(F.lit(["h2", "p", "ul", "table", "pre"]), (F.col("i") % 5 + 1).cast("int"))
    html = F.element_at(F.array(put("<h2>", "L", "</h2>"), put("<p>", "L", " <b>&amp;</b></p>"), put("<ul><li>", "L", "</li><li>x</li></ul>"), put("<table><tr><th>a</th><td>", "L", "</td></tr><tr><td>", "L", "</td></tr></table>"), put("<pre>", "L", "\n\n</pre>")), (F.col("i") % 5 + 1).cast("int"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), F.round(FL.html_height(tag, html, FL.TEXT_W), 6).alias("h"))


@query("documents")
def markdown_notes(d):
    """Documents as Markdown with notes in the margin and page breaks, as blocks."""
    i, put = F.col("i"), lambda *parts: F.concat(*[F.concat(F.lit("t "), "l") if x == "L" else F.lit(x) for x in parts])
    source = F.element_at(F.array(put("# ", "L", "\n"), put("L", "\n"), put("\n- ", "L", "\n- x"), put("::: {.column-margin}\n", "L", "\n\n1. one\n2. two\n:::"), put("> ", "L", "\n\n{{< pagebreak >}}")), (i % 5 + 1).cast("int"))
    lines = d.select(F.col("doc_id").alias("documentid"), F.posexplode(word_lines(F.col("text"))).alias("i", "l"))
    lines = lines.select("documentid", "i", F.posexplode(F.split(source, "\n")).alias("j", "line")).select("documentid", (i * 100 + F.col("j")).alias("line_no"), "line")
    found = N.noted_blocks(B.markdown_html(lines), "documentid")
    return found.select("documentid", F.col("block_index").cast("long").alias("block_index"), "kind", "tag", "html", F.array_join("notes", "|").alias("notes"))
