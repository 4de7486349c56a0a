"""Notes of imported HTML: whole elements are cut out of the text, and a mark is left where each belongs.

A page's notes lie in the page, so cutting them is a map over pages without a shuffle: tags are
matched with a stack of open ones. Numbers and places among the blocks are windows of a page.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.tables import small_batches
from quire.operators.blocks import import_blocks
from quire.operators.typeset import MARKUP, TAG, TOKEN, VOID

# Text elements that take a mark at their end, elements that stand between paragraphs.
TEXT = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre")
BETWEEN = ("aside", "div", "section", "figure")
MARK = r"\[\[note:\d+[nm]\]\]"
_ATTRIBUTE = re.compile(r"""\s(id|class|href)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)


class _Element:
    """A start tag at ``start``; ``end`` is the place of its end tag, None where there is none."""

    def __init__(self, name: str, start: int, parent: _Element | None, token: str) -> None:
        self.name, self.start, self.end, self.parent = name, start, None, parent
        given = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(token))}
        self.id, self.href, self.classes = given.get("id", ""), given.get("href", ""), set(given.get("class", "").split())


def elements(tokens: list[str]) -> list[_Element]:
    """Elements in the order of their start tags. An end tag closes the last open element of its name and whatever is open inside, which then has no end."""
    found, open_ = [], []
    for i, token in enumerate(tokens):
        m = TAG.match(token)
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            if any(e.name == name for e in open_):
                while (e := open_.pop()).name != name:
                    pass
                e.end = i
        elif name not in VOID and not token.endswith("/>"):
            e = _Element(name, i, open_[-1] if open_ else None, token)
            found.append(e)
            open_.append(e)
    return found


def cut_notes(html: str | None) -> tuple[str, list[tuple[bool, str]]]:
    """(html with marks, [(numbered, html) of each note]) of one page.

    Footnotes are references to #fn... with a list item of that id somewhere (the last of equal ones holds; links
    back are taken out), cut out with the sup around; side notes have the class sidenote. Both are
    numbered. Margin notes are aside elements and those of class marginnote, column-margin or aside.
    Containers and list items of footnotes and toggles go. Of notes inside notes the outermost counts.
    A mark [[note:kn]] or [[note:km]] (margin) holds the note's place k in the list. Notes that stand between
    paragraphs are marked at the end of the text element before them, or in a paragraph of their own.
    Notes without text and image leave nothing. References without a definition stay, elements without an end are no notes.
    """
    tokens = TOKEN.findall(html or "")
    found = [e for e in elements(tokens) if e.end is not None]
    definitions, spans = {}, []
    for e in found:
        if e.name == "li" and e.id.startswith("fn"):
            back = [b for b in found if e.start < b.start < e.end and b.name == "a" and (b.href.startswith("#fnref") or b.classes & {"footnote-backref", "footnote-back"})]
            hidden = {i for b in back for i in range(b.start, b.end + 1)}
            definitions[e.id] = "".join(tokens[i] for i in range(e.start + 1, e.end) if i not in hidden).strip()
    for e in found:
        inner = "".join(tokens[e.start + 1 : e.end]).strip() if e.classes or e.name == "aside" else ""
        if "footnotes" in e.classes or e.name == "li" and e.id in definitions or e.name == "label" and "margin-toggle" in e.classes:
            spans.append((e.start, e.end, None, e))
        elif e.name == "a" and e.href.startswith("#fn") and e.href[1:] in definitions:
            around = e.parent if e.parent is not None and e.parent.name == "sup" and e.parent.end is not None else e
            spans.append((around.start, around.end, (True, definitions[e.href[1:]]), around))
        elif "sidenote" in e.classes:
            spans.append((e.start, e.end, (True, inner), e))
        elif e.name == "aside" or e.classes & {"marginnote", "column-margin", "aside"}:
            spans.append((e.start, e.end, (False, inner), e))
    out: list[str | tuple[bool, str]] = []
    at = 0
    for start, end, note, e in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        out += tokens[at:start]
        at = end + 1
        if note is None or not re.sub(r"(?is)<(?!img\b)[^>]*>", "", note[1]).strip():
            continue
        place, alone = len(out), False
        if e.name in BETWEEN:
            before = next((i for i in range(len(out) - 1, -1, -1) if isinstance(out[i], str) and (m := TAG.match(out[i])) and m[2].lower() not in ("br", "wbr")), None)
            name, closed = (TAG.match(out[before])[2].lower(), bool(TAG.match(out[before])[1])) if before is not None else ("", False)
            if closed and name in TEXT:
                place = before
            else:
                alone = closed or name not in TEXT[:7]
        out[place:place] = ["<p>", note, "</p>"] if alone else [note]
    out += tokens[at:]
    notes, text = [], []
    for x in out:
        if isinstance(x, tuple):
            text.append(f"[[note:{len(notes)}{'n' if x[0] else 'm'}]]")
            notes.append(x)
        else:
            text.append(x)
    return "".join(text), notes


def noted_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, html, notes) of pages: their body without active elements by :func:`cut_notes`; notes is array<struct<numbered, html>>."""

    @F.pandas_udf("html string, notes array<struct<numbered:boolean,html:string>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = [cut_notes(t) for t in texts]
        return pd.DataFrame({"html": [r[0] for r in rows], "notes": [[{"numbered": n, "html": h} for n, h in r[1]] for r in rows]})

    small_batches(pages.sparkSession)
    return pages.select(key, cut(T.drop_active(T.body(F.col(html)))).alias("x")).select(key, "x.html", "x.notes")


def attach_notes(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (key, block_index, kind, tag, html, src, alt, caption) with marks, and rows of kind note (tag: mark) -> blocks with ``notes``, an array of html.

    Numbered notes count on through a page; their marks become their numbers, those of margin notes nothing. A
    text block of nothing but marks goes, and its notes come first in the next text block, those behind the last
    text block last in that one (a page without text loses them). Other blocks have no notes.
    """
    wide = Window.partitionBy(key).orderBy("block_index")
    text = F.col("kind") == "text"
    marks = F.when(text, F.regexp_extract_all("html", F.lit(r"\[\[note:(\d+[nm])\]\]"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    d = blocks.withColumn("__marks", marks)
    numbered = lambda m: F.endswith(m, F.lit("n"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("html", MARK, ""), r"(?s)<[^>]*>|&nbsp;", "")) == ""
    d = d.withColumn("__bare", F.coalesce(text & bare, F.lit(False))).withColumn("__n", F.size(F.filter("__marks", numbered)))
    d = d.withColumn("__base", F.sum("__n").over(wide.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    holds = F.when(text & ~F.col("__bare"), F.col("block_index"))
    ahead = F.first(holds, ignorenulls=True).over(wide.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(holds, ignorenulls=True).over(wide.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__holder", F.when(F.col("__bare"), F.coalesce(ahead, behind)).otherwise(F.col("block_index")))
    number = lambda m, i: F.when(numbered(m), F.col("__base") + F.size(F.filter(F.slice("__marks", 1, i + 1), numbered)))
    d = d.withColumn("__numbers", F.transform("__marks", number))
    sup = lambda n: F.coalesce(F.concat(F.lit("<sup>"), n.cast("string"), F.lit("</sup>")), F.lit(""))
    between = F.split("html", MARK)
    shown = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.when(i < F.size("__marks"), sup(F.try_element_at("__numbers", i + 1))).otherwise(""))), "")
    d = d.withColumn("html", F.when(F.size("__marks") > 0, shown).otherwise(F.col("html")))
    fields = [c for c in blocks.columns if c not in (key, "block_index")]
    apart = F.coalesce(F.col("kind") == "note", F.lit(False))
    own = F.when(~F.col("__bare") & ~apart, F.struct(*fields))
    given = F.when(apart, F.struct(F.col("tag").cast("int").alias("mark"), "html"))
    d = d.select(key, "__holder", "block_index", own.alias("__own"), given.alias("__given"), F.posexplode_outer(F.arrays_zip(F.col("__marks").alias("m"), F.col("__numbers").alias("n"))).alias("at", "__m"))
    d = d.withColumn("mark", F.coalesce("__given.mark", F.regexp_extract("__m.m", r"^(\d+)", 1).try_cast("int"))).withColumn("__own", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("__own")))
    d = d.withColumn("note", F.when(F.col("mark").isNotNull(), F.max("__given.html").over(Window.partitionBy(key, "mark")))).where("__given IS NULL")
    inner = F.when(F.rlike("note", F.lit(r"(?i)^<(p|ul|ol|div|table|figure|blockquote)\b")), F.col("note")).otherwise(F.concat(F.lit("<p>"), "note", F.lit("</p>")))
    inner = F.when(F.col("__m.n").isNull(), inner).otherwise(F.concat(F.regexp_replace(F.regexp_extract(inner, r"(?i)^(<p>)?", 1), r"(?i)<p>", F.concat(F.lit("<p>"), sup(F.col("__m.n")), F.lit(" "))), F.regexp_replace(inner, r"(?i)^<p>", "")))
    given = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("block_index", "at", inner.alias("html")))))
    out = d.groupBy(key, F.col("__holder").alias("block_index")).agg(F.first("__own", ignorenulls=True).alias("__own"), F.transform(given, lambda x: x["html"]).alias("notes"))
    return out.where("__own IS NOT NULL").select(key, "block_index", "__own.*", "notes")


def noted_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, block_index, kind, tag, html, src, alt, caption, notes) of pages whose notes stand beside the blocks."""
    cut = noted_pages(pages, key, html)
    return attach_notes(import_blocks(cut, key, notes="notes").drop("text"), key)
