"""The five tables of the data model, with fixed schemas; defaults fill in columns that older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "document": "id long, course long, name string, intro string, introformat int, pagerange string, enablereflow boolean, enableprint boolean, firstpageright boolean, ismaster boolean, masterid long, masterrange string, timecreated timestamp, timemodified timestamp",
    "source": "id long, documentid long, sourcetype string, title string, url string, author string, filename string, timeaccessed timestamp, showcitation boolean, timecreated timestamp, blocks string, hiddenblocks string, flowmap string, pagestyle string, startright boolean, measurekey string",
    "page": "id long, documentid long, sourceid long, sortorder int, pagetype string, content string, contentformat int, width int, height int, landscapelock boolean, spreadid long, spreadside string, pinside string, filler boolean, pagestyle string, staged boolean, layoutside string, timemodified timestamp",
    "overlay": "id long, pageid long, overlaytype string, x decimal(10,6), y decimal(10,6), w decimal(10,6), h decimal(10,6), data string, sortorder int, timemodified timestamp",
    "job": "id long, documentid long, status string, options string, filenames string, pagecount int, message string, timecreated timestamp, timemodified timestamp",
}
DEFAULTS = {"pagerange": "", "enablereflow": True, "enableprint": True, "firstpageright": True, "ismaster": False, "filler": False, "staged": False, "landscapelock": False, "pagetype": "image", "sortorder": 0, "showcitation": False, "startright": False}


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder by name; no schema is inferred."""
    return {name: with_defaults(spark.read.schema(s).parquet(f"{folder}/{name}.parquet"), name) for name, s in SCHEMAS.items()}


def with_defaults(rows: DataFrame, name: str) -> DataFrame:
    """rows in the table's schema: columns that are missing, or null, take their defaults."""
    out = []
    for f in T._parse_datatype_string(SCHEMAS[name]).fields:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        out.append((F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def write_pages(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Pages partitioned by a hash of their document, so that a document's pages lie together without one folder each."""
    with_defaults(rows, "page").repartition("documentid").sortWithinPartitions("documentid", "sortorder", "id").write.mode(mode).parquet(folder)


def write_overlays(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Overlays with the table's schema and defaults, together by page."""
    with_defaults(rows, "overlay").repartition("pageid").sortWithinPartitions("pageid", "sortorder", "id").write.mode(mode).parquet(folder)


def appended(rows: DataFrame, there: DataFrame, parent: str) -> DataFrame:
    """rows (parent, ...) with ``sortorder`` counted on from the last one of their parent among those that are there, in the order of ids."""
    last = there.groupBy(parent).agg(F.max("sortorder").alias("__last"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy("id"))
    return rows.withColumn("sortorder", place).join(last, parent, "left").withColumn("sortorder", (F.coalesce("__last", F.lit(0)) + F.col("sortorder")).cast("int")).drop("__last")


def record_sources(files: DataFrame) -> DataFrame:
    """files (documentid, sourcetype, title, url, author, filename) as trimmed source rows, title and author cut to their widths."""
    cut = lambda c, n: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, n).alias(c)
    return files.select("documentid", "sourcetype", cut("title", 1333), cut("url", 1333), cut("author", 255), cut("filename", 255))
