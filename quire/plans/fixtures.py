"""Input views over the given tables; the text is valid in Spark and in DuckDB."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings")
_LINE = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k, count(*) over (partition by l_orderkey) as n from lineitem) t"

VIEWS = {
    "fx_document": """select o_orderkey as id, o_custkey % 50 as course, o_orderkey % 4 <> 0 as firstpageright,
 case o_orderkey % 6 when 0 then '' when 1 then '2-3, 6' when 2 then '4, 1-2,6-' when 3 then '2-40' when 4 then '5-2' else '1-' end as pagerange,
 o_orderkey % 5 = 0 as ismaster, case when o_orderkey % 7 = 3 then o_custkey * 15 end as masterid from orders""",
    "fx_page": f"""select l_orderkey as documentid, l_orderkey * 100 + k as id, k as sortorder, l_suppkey as sourceid,
 case when l_quantity < 10 then 'canvas' when l_quantity < 40 then 'image' else 'html' end as pagetype,
 case when l_quantity > 45 then 1754 else 1240 end as width, case when l_quantity > 45 then 1240 else 1754 end as height,
 l_quantity > 45 as landscapelock,
 case when l_orderkey % 3 = 0 and (k % 2 = 0 or k < n) then l_orderkey * 100 + k - (1 - k % 2) end as spreadid,
 case when l_orderkey % 3 = 0 and (k % 2 = 0 or k < n) then case when k % 2 = 1 then 'left' else 'right' end end as spreadside,
 case when l_orderkey % 3 <> 0 then case l_partkey % 5 when 0 then 'left' when 1 then 'right' end end as pinside,
 l_quantity < 10 and l_partkey % 3 = 0 as filler, l_suppkey % 10 = 0 as staged
 from {_LINE}""",
    "fx_overlay": f"""select l_orderkey * 100 + k as id, l_orderkey * 100 + (k * 7) % n + 1 as pageid,
 case l_partkey % 8 when 0 then 'textframe' when 1 then 'imageframe' when 2 then 'textbox' when 3 then 'mask' when 4 then 'audio' when 5 then 'glossary' when 6 then 'reflow' else 'column' end as overlaytype,
 cast(l_discount * 8 as decimal(10,6)) as x, cast(l_tax * 10 as decimal(10,6)) as y, cast(l_quantity / 100 as decimal(10,6)) as w, cast(0.1 as decimal(10,6)) as h, k as sortorder
 from {_LINE}""",
    "fx_source": """select s.s_suppkey as id, case s_suppkey % 4 when 0 then 'web' when 1 then 'md' when 2 then 'pdf' else 'image' end as sourcetype, case when s_suppkey % 6 = 0 then '' else s_name end as title,
 case when s_suppkey % 4 = 0 then 'https://example.org/' || cast(s_suppkey as varchar(20)) end as url, case s_suppkey % 3 when 0 then '' when 1 then '0' else s_name end as author,
 'file' || cast(s_suppkey as varchar(20)) || '.pdf' as filename, s_suppkey % 5 <> 0 as showcitation from supplier s""",
    "fx_job": "select event_id as id, user_id as documentid, case event_type when 'click' then 'queued' when 'view' then 'running' when 'error' then 'failed' else 'done' end as status, value, ts from events",
    "fx_view": "select user_id, event_id % 40 as documentid, ts from events where event_type = 'view'",
    "fx_glossary": "select p_partkey as id, p_size as glossaryid, p_name as concept, p_brand as alias, p_partkey % 3 <> 0 as approved from part",
    "fx_line": """select conv_id as documentid, turn as line_no, case when turn % 5 = 4 then '{{< pagebreak >}}' when role = 'system' then '::: {.columns}' when role = 'user' then '::: {.column width="40%"}' else ':::' end as line from conversations""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of sf_dir."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(*names: str) -> str:
    """The WITH clause that gives SQL the same views."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)


def word_lines(text: Column) -> Column:
    """The lines of a text that hold a letter or digit of ASCII, without signs of markup, blanks collapsed."""
    clean = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.translate(x, "<>&[]", "     "), r"[ \t\r\f]+", " ")))
    return F.filter(clean, lambda x: F.rlike(x, F.lit("[a-zA-Z0-9]")))


def word_file(lines: Column) -> Column:
    """Word documents made of arrays of lines, see _word_files."""
    return F.pandas_udf(_word_files, "binary")(lines)


def _word_files(lines: pd.Series) -> pd.Series:
    """A Word document of each array of lines: by turns a heading, two list items, a paragraph with a note and a picture, a table, and a paragraph that ends the page."""
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = []
    for some in lines:
        body, notes, links, pictures = [], [], [], {}
        for i, line in enumerate(some):
            t = f"<w:t>{escape(line)}</w:t>"
            p = lambda about, runs: f"<w:p><w:pPr>{about}</w:pPr>{runs}</w:p>"
            if i % 6 == 0:
                body.append(p('<w:pStyle w:val="Heading 1"/>', f"<w:r>{t}</w:r>"))
            elif i % 6 < 3:
                body.append(p("<w:numPr/>", f"<w:r><w:rPr><w:b{'' if i % 6 == 1 else ' w:val="0"'}/></w:rPr>{t}</w:r>"))
            elif i % 6 == 3:
                body.append(p("", f'<w:r>{t}</w:r><w:r><w:rPr><w:i/></w:rPr><w:footnoteReference w:id="{1000 - i}"/></w:r><w:r><w:drawing><a:blip r:embed="rId{i}"/></w:drawing></w:r>'))
                notes.append(f'<w:footnote w:id="{1000 - i}"><w:p><w:r><w:t>note {i}</w:t></w:r></w:p><w:p/></w:footnote>')
                links.append(f'<Relationship Id="rId{i}" Target="media/image{i}.png"/>')
                if i % 12 == 3:
                    pictures[f"word/media/image{i}.png"] = f"picture {i}"
            elif i % 6 == 4:
                inner = f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in {i}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
                body.append(f"<w:tbl><w:tr><w:tc><w:p><w:r>{t}</w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>{inner}</w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>")
            else:
                body.append(p("", f'<w:r>{t}<w:br/><w:br w:type="page"/></w:r>'))
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("word/document.xml", f"<w:document {names}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
            z.writestr("word/footnotes.xml", f"<w:footnotes {names}>{''.join(reversed(notes))}</w:footnotes>")
            z.writestr("word/_rels/document.xml.rels", f"<Relationships>{''.join(links)}</Relationships>")
            for name, data in pictures.items():
                z.writestr(name, data)
        out.append(made.getvalue())
    return pd.Series(out)
