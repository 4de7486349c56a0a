"""Text and HTML functions as column expressions; every regular expression is linear and works on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are dropped with their content, entities, snapped column widths.
ACTIVE = ("script", "style", "noscript", "iframe", "object", "embed", "svg", "template", "button", "select", "textarea")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
WIDTHS = (20, 25, 30, 33, 40, 50, 60, 66, 70, 75, 80)
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre")


def body(html: Column) -> Column:
    """What <body> holds, or the whole where there is none."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(inner != "", inner).otherwise(html)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def drop_active(html: Column) -> Column:
    """html without elements that act."""
    for tag in ACTIVE:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


# Elements and attributes that may stand in a page, addresses that a link or picture may have.
SAFE_TAGS = "a|abbr|b|blockquote|br|caption|cite|code|col|colgroup|dd|del|div|dl|dt|em|figcaption|figure|h1|h2|h3|h4|h5|h6|hr|i|img|ins|kbd|li|mark|ol|p|pre|q|s|section|small|span|strong|sub|sup|table|tbody|td|tfoot|th|thead|tr|u|ul|var"
SAFE_ATTRIBUTES = "alt|class|colspan|height|href|id|lang|rowspan|src|title|width"
SAFE_URL = r"""(?i)^["'](https?://|mailto:|[#/?]|\.{1,2}/|data:image/(png|jpe?g|gif|webp);base64,|[^:&]*["']$)"""


def purified(html: Column) -> Column:
    """html with nothing but known elements and attributes: scripts, event handlers, styles and comments go, text stays.

    Of links and pictures only addresses of the web, of mail, of this site or of a picture's own data stay; an attribute needs quotes. A
    sign < that begins no tag is written as an entity.
    """
    parts = F.regexp_extract_all(drop_active(html), F.lit(r"""(?s)(<!--.*?-->|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<)"""), F.lit(1))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    pairs = lambda t: F.regexp_extract_all(t, F.lit(rf"""(?i)\s((?:{SAFE_ATTRIBUTES})\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    value = lambda a: F.regexp_extract(a, r"(?s)=\s*(.*)$", 1)
    kept = lambda t: F.filter(pairs(t), lambda a: ~F.rlike(a, F.lit(r"(?i)^(href|src)\s*=")) | F.rlike(value(a), F.lit(SAFE_URL)))

    def part(t: Column) -> Column:
        known = F.rlike(name(t), F.lit(f"^({SAFE_TAGS})$"))
        start = F.concat(F.lit("<"), name(t), F.when(F.size(kept(t)) > 0, F.concat(F.lit(" "), F.array_join(kept(t), " "))).otherwise(""), F.lit(">"))
        return F.when(t == "<", "&lt;").when(~F.startswith(t, F.lit("<")), t).when(F.startswith(t, F.lit("</")), F.when(known, F.concat(F.lit("</"), name(t), F.lit(">"))).otherwise("")).otherwise(F.when(known, start).otherwise(""))

    return F.array_join(F.transform(parts, part), "")


def plain_text(html: Column) -> Column:
    """Tags become spaces, entities characters, white space single spaces."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def bare_text(html: Column) -> Column:
    """Text of a piece of html without anything in the place of its tags; entities are characters, blanks of ASCII single spaces."""
    t = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0b]+", " "))


def preview(html: Column, most: int = 120) -> Column:
    """Plain text, cut at the last space within ``most`` characters, with an ellipsis."""
    t = plain_text(html)
    head = F.regexp_extract(F.substring(t, 1, most), r"^(.*)\s", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(head != "", head).otherwise(F.substring(t, 1, most)), F.lit("…")))


def passage_kind(tag: Column) -> Column:
    return F.when(F.rlike(tag, F.lit("^h[1-6]$")), "heading").when(tag.isin("ul", "ol"), "list").when(tag == "table", "table").when(tag.isin("img", "image"), "image").otherwise("text")


def tokens(html: Column) -> Column:
    """Tags and the text between them, in order."""
    return F.regexp_extract_all(drop_active(html), F.lit(r"(<[^>]+>|[^<]+)"), F.lit(1))


def absolute_url(base: Column, rel: Column) -> Column:
    """rel seen from base; null for data: and javascript: and where base has no host."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    host = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    tail = F.regexp_extract(rel, r"([?#].*)$", 1)
    parts = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_replace(rel, r"[?#].*$", "")), "/")
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, empty, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    slash = F.when(F.rlike(F.regexp_replace(rel, r"[?#].*$", ""), F.lit(r"(^|/)\.{0,2}$")), "/").otherwise("")
    joined = F.concat(root, F.lit("/"), F.array_join(walked, "/"), F.when(F.size(walked) > 0, slash).otherwise(""), tail)
    return (
        F.when(rel.isNull() | F.rlike(rel, F.lit(r"(?i)^\s*(data|javascript|mailto):")), F.lit(None).cast("string"))
        .when(F.rlike(rel, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")), rel)
        .when(host == "", F.lit(None).cast("string"))
        .when(F.startswith(rel, F.lit("//")), F.concat(scheme, F.lit(":"), rel))
        .when(F.startswith(rel, F.lit("/")), F.concat(root, rel))
        .when(F.startswith(rel, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), rel))
        .when(F.startswith(rel, F.lit("?")), F.concat(root, F.when(path == "", "/").otherwise(path), rel))
        .otherwise(joined)
    )


def attribute_map(text: Column) -> Column:
    """struct<classes, id, attrs> of ``.a #b k=v k2="v w"``; keys in lower case, the last of a key wins."""
    pattern = r"""(?:^|\s)([a-zA-Z][\w-]*)=("[^"]*"|'[^']*'|\S+)"""
    keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    bare = F.regexp_replace(text, r"""[a-zA-Z][\w-]*=("[^"]*"|'[^']*'|\S+)""", " ")
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    distinct = F.array_distinct(keys)
    last = F.map_from_entries(F.transform(distinct, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))
    ids = F.regexp_extract_all(bare, F.lit(r"(?:^|\s)#([\w-]+)"), F.lit(1))
    return F.struct(F.regexp_extract_all(bare, F.lit(r"(?:^|\s)\.([\w-]+)"), F.lit(1)).alias("classes"), F.when(F.size(ids) > 0, F.element_at(ids, -1)).alias("id"), last.alias("attrs"))


def snapped_width(percent: Column) -> Column:
    """The nearest allowed column width; of two the first."""
    best = F.array_min(F.array(*[F.struct(F.abs(percent - w).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(WIDTHS)]))
    return best["w"]


def image_refs(text: Column) -> Column:
    """array<struct<alt, src, attrs>> of ``![alt](src){attrs}``."""
    p = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)(?:\{([^}]*)\})?"
    part = lambda k: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    return F.transform(part(2), lambda src, i: F.struct(F.element_at(part(1), i + 1).alias("alt"), src.alias("src"), F.element_at(part(3), i + 1).alias("attrs")))


def callout_title(attribute: Column, text: Column, default: str) -> Column:
    """struct<title, body>: the attribute, or a leading heading (taken out of the body), or the default."""
    heading = F.regexp_extract(text, r"^\s*#{1,6}\s+([^\n]+)", 1)
    taken = (F.coalesce(attribute, F.lit("")) == "") & (heading != "")
    return F.struct(F.when(F.coalesce(attribute, F.lit("")) != "", attribute).when(heading != "", F.trim(heading)).otherwise(default).alias("title"), F.when(taken, F.regexp_replace(text, r"^\s*#{1,6}\s+[^\n]+\n?", "")).otherwise(text).alias("body"))


def charset(content_type: Column, html: Column) -> Column:
    """From the content type, else from meta, else utf-8; in lower case."""
    of = lambda c, p: F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)), F.lit(""))
    return F.coalesce(of(content_type, r"(?i)charset=\"?([\w-]+)"), of(html, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)"), F.lit("utf-8"))


def word_heading(style: Column) -> Column:
    """h2 .. h4 of a style name, or null."""
    n = F.regexp_extract(style, r"(?i)(?:heading|berschrift)\s*(\d)", 1)
    return F.when(n != "", F.concat(F.lit("h"), F.greatest(F.lit(2), F.least(F.lit(4), n.try_cast("int") + 1)).cast("string"))).when(F.lower(style) == "title", "h2")


def natural_key(name: Column) -> Column:
    """Sort key of natural, case-insensitive file name order: numbers by value, of any length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d+$")), F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))).otherwise(p)), "")


def split_text(text: Column, budget: Column | int) -> Column:
    """struct<head, tail>: text cut at the last space before a budget of characters (20 at least); no space, no cut."""
    most = F.greatest(F.lit(20), F.lit(budget) if isinstance(budget, int) else budget)
    head = F.regexp_extract(F.substr(text, F.lit(1), most), r"^(.*) ", 1)
    short = F.length(text) <= most
    return F.struct(F.when(short | (head == ""), text).otherwise(head).alias("head"), F.when(short | (head == ""), "").otherwise(F.substr(text, F.length(head) + 2)).alias("tail"))


def portable_links(text: Column, base: str) -> Column:
    """Links to documents of this site (``base`` followed by an id) as tokens that another site can read."""
    import re

    return F.regexp_replace(text, re.escape(base) + r"(\d+)", "@@DOC*$1@@")
