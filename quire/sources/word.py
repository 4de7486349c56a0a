"""Word documents: one pass over each archive gives narrow rows of all its parts; everything else is joins and windows of a file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.tables import small_batches

# Name spaces of Word documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

PARTS = (
    "path string, part string, item int, trow int, tcell int, depth int, paragraph int, run int, piece int, kind string, value string, style string, list boolean, bold boolean, italic boolean, break boolean, data binary"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _pieces(paragraph: ElementTree.Element) -> Iterator[tuple]:
    """(run, piece, kind, value, bold, italic) of a paragraph: a run's images, then its text, tabs, breaks and note references in order."""
    for r, run in enumerate(paragraph.iter(f"{W}r")):
        on = lambda tag, run=run: any(x.get(f"{W}val") != "0" for x in run.findall(f"{W}rPr/{W}{tag}"))
        found = [("image", x.get(f"{R}embed")) for x in run.iter(f"{A}blip") if x.get(f"{R}embed")]
        for child in run:
            name = child.tag.removeprefix(W)
            if name == "t":
                found.append(("text", child.text or ""))
            elif name == "tab":
                found.append(("text", " "))
            elif name == "br" and child.get(f"{W}type") != "page":
                found.append(("break", None))
            elif name == "footnoteReference":
                found.append(("note", child.get(f"{W}id")))
        for p, (kind, value) in enumerate(found):
            yield r, p, kind, value, on("b"), on("i")


def _cells(table: ElementTree.Element, depth: int) -> Iterator[tuple[int, int, int, ElementTree.Element]]:
    """(row, cell, depth, paragraph) of a table; the paragraphs of tables inside a cell belong to that cell, in order."""
    for i, row in enumerate(table.findall(f"{W}tr")):
        for j, cell in enumerate(row.findall(f"{W}tc")):
            for node in cell:
                if node.tag == f"{W}p":
                    yield i, j, depth, node
                elif node.tag == f"{W}tbl":
                    yield from ((i, j, d, p) for _, _, d, p in _cells(node, depth + 1))


def _parts(path: str | None, content: bytes | None) -> Iterator[tuple]:
    blank = (None,) * 15
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
        names = set(archive.namelist())
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        notes = ElementTree.fromstring(archive.read("word/footnotes.xml")) if "word/footnotes.xml" in names else None
        links = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else ()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError, OSError) as e:
        yield path, "error", *blank[:7], "error", str(e) or type(e).__name__, *blank[:6]
        return
    for link in links:
        target = link.get("Target") or ""
        if target.startswith("media/"):
            yield path, "relation", *blank[:7], link.get("Id"), f"word/{target}", *blank[:6]
    for name in sorted(n for n in names if n.startswith("word/media/") and not n.endswith("/")):
        try:
            yield path, "media", *blank[:7], "media", name, *blank[:5], archive.read(name)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
            yield path, "error", *blank[:7], "error", f"{name}: {e}", *blank[:6]
    for item, node in enumerate(body if body is not None else ()):
        if node.tag == f"{W}tbl":
            for n, (i, j, depth, p) in enumerate(_cells(node, 1)):
                yield path, "body", item, i, j, depth, n, None, None, "paragraph", None, None, False, None, None, False, None
                for r, k, kind, value, bold, italic in _pieces(p):
                    yield path, "body", item, i, j, depth, n, r, k, kind, value, None, False, bold, italic, False, None
        elif node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            about = style.get(f"{W}val") if style is not None else None, node.find(f"{W}pPr/{W}numPr") is not None
            ends = any(x.get(f"{W}type") == "page" for x in node.iter(f"{W}br"))
            yield path, "body", item, None, None, 0, 0, None, None, "paragraph", None, *about, None, None, ends, None
            for r, k, kind, value, bold, italic in _pieces(node):
                yield path, "body", item, None, None, 0, 0, r, k, kind, value, *about, bold, italic, ends, None
    for note in notes if notes is not None else ():
        for n, p in enumerate(note.findall(f"{W}p")):
            for r, k, kind, value, bold, italic in _pieces(p):
                yield path, "note", None, None, None, 0, n, r, k, kind, value, note.get(f"{W}id"), False, bold, italic, False, None


def word_parts(files: DataFrame, rows: int = 2_000) -> DataFrame:
    """files (path, content) -> rows of all parts of each Word document, so that an archive is opened once.

    part is body, note (a footnote, its id as style), relation (kind: id, value: entry), media (value: entry, data) or error
    (value: message). A body row is a paragraph or a piece of one of its runs: kind text, break, image (value: relation) or note (value: footnote's id). item
    counts what the body holds; rows of tables also have trow, tcell and depth (2 and more inside of
    other tables). A file that can't be read is an error row; a null content is one. Write the result before using it more than once.
    """
    fields = [x.split() for x in PARTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*found), fields)], [n for n, _ in fields])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = []
                for row in _parts(path, content.as_py()):
                    found.append(row)
                    if len(found) >= rows or row[-1] is not None:
                        yield packed(found)
                        found = []
                if found:
                    yield packed(found)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(read, PARTS)


def word_media(parts: DataFrame) -> DataFrame:
    """(path, id, src, filename, data): pictures by relation; relations without an entry and entries without a relation are left out."""
    d = parts.where("part IN ('relation', 'media') AND path IS NOT NULL").select("path", F.col("value").alias("entry"), "part", "kind", "data")
    of = lambda part, c: F.collect_list(F.when(F.col("part") == part, F.struct(c)))
    d = d.groupBy("path", "entry").agg(of("relation", "kind").alias("links"), of("media", "data").alias("media"))
    d = d.select("path", "entry", F.explode("links").alias("l"), "media").select("path", "entry", F.col("l.kind").alias("id"), F.explode("media").alias("m"))
    return d.select("path", "id", F.concat(F.lit("docx:"), "entry").alias("src"), F.element_at(F.split("entry", "/"), -1).alias("filename"), "m.data")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _joined(*order: str, value: str = "html", by: str = "") -> Column:
    """An aggregate: values in an order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), by)


def word_notes(parts: DataFrame) -> DataFrame:
    """(path, id, number): footnotes numbered by their first reference in the body."""
    order = F.struct("item", "paragraph", "run", "piece")
    first = parts.where("part = 'body' AND kind = 'note'").groupBy("path", F.col("value").alias("id")).agg(F.min(order).alias("at"))
    return first.select("path", "id", F.row_number().over(Window.partitionBy("path").orderBy("at")).alias("number"))


def _paragraphs(parts: DataFrame) -> DataFrame:
    """(path, part, item, trow, tcell, paragraph, style, list, break, number, html): runs put together, bold and italic as tags, pictures before a run's text.

    What a run refers to is looked up in windows of its file, so one shuffle serves everything. number is
    that of a footnote by its first reference; notes that nothing refers to are left out.
    """
    d = parts.where("part IN ('body', 'note', 'relation', 'media')").drop("data").repartition("path")
    image, link = F.col("part").isin("body", "note") & (F.col("kind") == "image"), F.col("part") == "relation"
    there = F.max((F.col("part") == "media").cast("int")).over(Window.partitionBy("path", F.when(F.col("part").isin("relation", "media"), F.col("value"))))
    d = d.withColumn("__entry", F.when(link & (there == 1), F.col("value")))
    d = d.withColumn("__src", F.max("__entry").over(Window.partitionBy("path", F.when(image, F.col("value")).when(link, F.col("kind")))))
    refers = (F.col("part") == "body") & (F.col("kind") == "note")
    d = d.withColumn("__note", F.when(F.col("kind") == "note", F.col("value")).when(F.col("part") == "note", F.col("style")))
    noted = Window.partitionBy("path", "__note")
    d = d.withColumn("__at", F.when(F.col("__note").isNotNull(), F.min(F.when(refers, F.struct("item", "paragraph", "run", "piece"))).over(noted)))
    d = d.withColumn("number", F.when(F.col("__at").isNotNull(), F.dense_rank().over(Window.partitionBy("path", F.col("__at").isNull()).orderBy("__at"))))
    d = d.where("part = 'body' OR (part = 'note' AND number IS NOT NULL)")
    n = F.col("number").cast("string")
    link = F.concat(F.lit('<sup><a href="#fn:'), n, F.lit('" class="footnote-ref">'), n, F.lit("</a></sup>"))
    html = F.when(F.col("kind") == "text", _escaped(F.col("value"))).when(F.col("kind") == "break", "<br>").when(F.col("kind") == "note", link)
    shown = F.when(image & F.col("__src").isNotNull(), F.concat(F.lit('<img src="docx:'), "__src", F.lit('" alt="">')))
    d = d.withColumn("html", html).withColumn("image", shown).withColumn("number", F.when(F.col("part") == "note", F.col("number")))
    keys = ["path", "part", "item", "trow", "tcell", "paragraph", "style", "list", "break", "number"]
    runs = d.groupBy(*keys, "run").agg(_joined("piece").alias("text"), _joined("piece", value="image").alias("images"), F.first("bold").alias("bold"), F.first("italic").alias("italic"))
    text = F.when(F.col("bold"), F.concat(F.lit("<strong>"), "text", F.lit("</strong>"))).otherwise(F.col("text"))
    text = F.when(F.col("italic"), F.concat(F.lit("<em>"), text, F.lit("</em>"))).otherwise(text)
    return runs.withColumn("html", F.concat("images", F.when(F.col("text") == "", "").otherwise(text))).groupBy(*keys).agg(_joined("run").alias("html"))


def word_pages(parts: DataFrame) -> DataFrame:
    """(path, page_no, html) of Word documents, cut behind paragraphs with a page break; pages without text or markup are left out.

    Styles named Heading, Title or ...berschrift give h2 to h4, consecutive list items one list, tables rows of
    cells with their paragraphs on lines. The footnotes that are referred to stand as a list at the end of the last page.
    """
    p, note, cell = _paragraphs(parts), F.col("part") == "note", F.col("trow").isNotNull()
    p = p.withColumn("html", F.when(cell, F.concat(F.lit("<br>"), "html")).when(note, F.when(F.trim("html") == "", "").otherwise(F.concat(F.lit("<p>"), F.trim("html"), F.lit("</p>")))).otherwise(F.col("html")))
    keys = ["path", "part", "item", "number", "style", "list", "break"]
    cells = p.groupBy(*keys, "trow", "tcell").agg(_joined("paragraph").alias("html")).withColumn("html", F.when(cell, F.concat(F.lit("<td>"), F.substring("html", 5, 2**30), F.lit("</td>"))).otherwise(F.col("html")))
    rows = cells.groupBy(*keys, "trow").agg(_joined("tcell").alias("html")).withColumn("html", F.when(cell, F.concat(F.lit("<tr>"), "html", F.lit("</tr>"))).otherwise(F.col("html")))
    items = rows.groupBy(*keys).agg(F.bool_or(cell).alias("table"), _joined("trow").alias("html"))
    w = Window.partitionBy("path").orderBy("part", "item", "number")  # the body, then the notes
    items = items.withColumn("page_no", F.coalesce(F.sum(F.when(~note, F.col("break").cast("int")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    kind = F.when(note, "note").when(F.col("list"), "list").otherwise("other")
    items = items.withColumn("__kind", kind)
    apart = lambda f: ~F.coalesce((f("__kind").over(w) == F.col("__kind")) & (f("page_no").over(w) == F.col("page_no")), F.lit(False))
    items = items.withColumn("__first", apart(F.lag)).withColumn("__last", apart(F.lead)).withColumn("__n", F.row_number().over(w))
    style = F.coalesce("style", F.lit(""))
    digit = F.coalesce(F.regexp_extract(style, r"(?i)(?:Heading|berschrift|Title)\s*(\d?)", 1).try_cast("int"), F.lit(1))
    level = F.least(F.lit(4), F.greatest(F.lit(1), digit) + 1).cast("string")
    around = lambda first, one, last: F.concat(F.when(F.col("__first"), first).otherwise(""), one, F.when(F.col("__last"), last).otherwise(""))
    html = (
        F.when(note, around('<div class="footnotes"><hr><ol>', F.concat(F.lit('<li id="fn:'), F.col("number").cast("string"), F.lit('">'), "html", F.lit("</li>")), "</ol></div>"))
        .when(F.col("table"), F.concat(F.lit("<table>"), "html", F.lit("</table>"))).when(F.col("list"), around("<ul>", F.concat(F.lit("<li>"), "html", F.lit("</li>")), "</ul>"))
        .when(F.rlike(style, F.lit("(?i)Heading|berschrift|Title")), F.concat(F.lit("<h"), level, F.lit(">"), "html", F.lit("</h"), level, F.lit(">"))).when(F.col("html") != "", F.concat(F.lit("<p>"), "html", F.lit("</p>"))).otherwise("")
    )
    return items.withColumn("html", html).groupBy("path", "page_no").agg(_joined("__n").alias("html")).where("trim(html) <> ''")
