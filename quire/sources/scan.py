"""Files, archives and Word documents as rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import natural_key

# File name endings and the source types they become; options of an import.
KINDS = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "md": "md", "markdown": "md", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "tif": "image", "tiff": "image", "cbz": "cbz", "zip": "cbz"}
OPTIONS = ("chop", "deskew", "shadow", "split")
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def route(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): files with sourcetype and title by their ending; unknown endings carry a message."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    d = files.withColumn("filename", name).withColumn("sourcetype", F.try_element_at(kinds, ext)).withColumn("title", F.regexp_replace(name, r"\.[^.]+$", ""))
    return d.where("sourcetype IS NOT NULL"), d.where("sourcetype IS NULL").withColumn("message", F.concat(F.lit("unknown file type: "), F.col("filename")))


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Routed files of a folder, contents included."""
    return route(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of whole Markdown files."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_page_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of raster pages, in natural order of their names; undecodable ones are dropped."""
    d = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    return d.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data").withColumn("order_key", natural_key(F.col("path")))


def inline_images(blocks: DataFrame, src: str = "src") -> DataFrame:
    """blocks with ``data``: the bytes of a base64 data URI, null where there is none or it is broken."""
    return blocks.withColumn("data", F.try_to_binary(F.nullif(F.regexp_extract(F.coalesce(F.col(src), F.lit("")), r"^data:image/[a-z+.-]+;base64,(.*)$", 1), F.lit("")), F.lit("base64")))


def media_checked(files: DataFrame, most: int, mime: str = "mimetype", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): audio, webm and the common pictures, up to ``most`` bytes."""
    known = F.startswith(mime, F.lit("audio/")) | F.col(mime).isin("video/webm", "image/png", "image/jpeg", "image/gif", "image/webp")
    reason = F.when(~F.coalesce(known, F.lit(False)), "type").when(F.length(content) > most, "size")
    d = files.withColumn("reason", reason)
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL")


def cleanup_options(options, sourcetype):
    """Allowed cleanup options; archives ignore split and deskew."""
    allowed = F.array_intersect(options, F.array(*[F.lit(o) for o in OPTIONS]))
    return F.when(sourcetype == "cbz", F.array_except(allowed, F.array(F.lit("split"), F.lit("deskew")))).otherwise(allowed)


def _natural(name: str) -> list:
    """Natural, case-insensitive order: numbers by value."""
    return [(0, int(x), x) if x.isdigit() else (1, x, "") for x in re.findall(r"\d+|\D+", name.lower())]


def archive_images(files: DataFrame, most: int = 300) -> DataFrame:
    """files (path, content) -> (path, page_no, entry, data, message): pictures of zip archives in natural order, at most ``most`` of each.

    Order and limit come from the archive's directory, so nothing else is unpacked, one picture at a
    time. Folders named __MACOSX are skipped. An archive or a picture that can't be read is a row with a
    message (an archive's without page_no) and without data; a picture like this keeps its place.
    """
    schema = "path string, page_no int, entry string, data binary, message string"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()))], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                    names = [n for n in dict.fromkeys(z.namelist()) if re.search(r"(?i)\.(png|jpe?g|gif|webp)$", n) and "__MACOSX" not in n]
                except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, ValueError) as e:
                    yield row(path, None, None, None, str(e) or type(e).__name__)
                    continue
                for k, name in enumerate(sorted(names, key=lambda n: (_natural(n), n))[:most]):
                    try:
                        yield row(path, k + 1, name, z.read(name), None)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                        yield row(path, k + 1, name, None, str(e) or type(e).__name__)

    return files.select("path", "content").mapInArrow(entries, schema)


def docx_runs(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, paragraph, run, style, list, bold, italic, break, footnote, text) of Word documents."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "paragraph", "run", "style", "list", "bold", "italic", "break", "footnote", "text"]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for p, para in enumerate(root.iter(f"{W_NS}p")):
                    style = para.find(f"{W_NS}pPr/{W_NS}pStyle")
                    listed = para.find(f"{W_NS}pPr/{W_NS}numPr") is not None
                    for r, run in enumerate(para.iter(f"{W_NS}r")):
                        note = run.find(f"{W_NS}footnoteReference")
                        has = lambda tag, run=run: run.find(f"{W_NS}rPr/{W_NS}{tag}") is not None
                        page = any(x.get(f"{W_NS}type") == "page" for x in run.iter(f"{W_NS}br"))
                        rows.append((path, p, r, style.get(f"{W_NS}val") if style is not None else None, listed, has("b"), has("i"), page, note.get(f"{W_NS}id") if note is not None else None, "".join(t.text or "" for t in run.iter(f"{W_NS}t"))))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(runs, "path string, paragraph int, run int, style string, list boolean, bold boolean, italic boolean, break boolean, footnote string, text string")


def docx_paragraphs(runs: DataFrame) -> DataFrame:
    """(path, paragraph, segment, style, list_run, text): pages end behind paragraphs with a break; consecutive list items share a list_run."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    p = runs.groupBy("path", "paragraph").agg(text.alias("text"), F.first("style").alias("style"), F.bool_or("list").alias("list"), F.bool_or("break").alias("brk"))
    w = Window.partitionBy("path").orderBy("paragraph")
    begins = F.col("list") & ~F.coalesce(F.lag("list").over(w), F.lit(False))
    d = p.withColumn("segment", F.coalesce(F.sum(F.col("brk").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__b", begins)
    return d.withColumn("list_run", F.when(F.col("list"), F.sum(F.col("__b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__b", "brk", "list")


def docx_footnotes(runs: DataFrame) -> DataFrame:
    """(path, footnote, number): footnotes numbered by their first reference."""
    first = runs.where("footnote IS NOT NULL").groupBy("path", "footnote").agg(F.min(F.struct("paragraph", "run")).alias("at"))
    return first.select("path", "footnote", F.row_number().over(Window.partitionBy("path").orderBy("at")).alias("number"))
