"""Sources and citations, lineage, glossaries, import jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Whether a string counts as given: neither null nor empty nor "0"."""
    return F.coalesce(~c.isin("", "0"), F.lit(False))


def has_citation() -> Column:
    return F.col("showcitation") & (filled(F.col("url")) | filled(F.col("author")))


def citation(accessed: Column | None = None) -> Column:
    """Author, title or else file name, and the access date where there is a url."""
    title = F.when(filled(F.col("title")), F.col("title")).otherwise(F.col("filename"))
    date = F.when(filled(F.col("url")), F.date_format(accessed, "dd.MM.yyyy")) if accessed is not None else F.lit(None)
    return F.concat_ws(", ", F.when(filled(F.col("author")), F.col("author")), title, date)


def citation_plain() -> Column:
    """Author, title, url as given; without a title there is none."""
    return F.concat_ws(", ", *[F.when(filled(F.col(c)), F.col(c)) for c in ("author", "title", "url")])


def printed_citation(label: str = "Source: ", accessed: Column | None = None, word: str = "accessed ") -> Column:
    """What stands under a printed page: a label before author, title and url, the access date behind a url; empty where nothing is given or shown."""
    date = F.when(filled(F.col("url")), F.concat(F.lit(word), F.date_format(accessed, "dd.MM.yyyy"))) if accessed is not None else F.lit(None)
    text = F.concat_ws(", ", *[F.when(filled(F.col(c)), F.col(c)) for c in ("author", "title", "url")], date)
    return F.when(has_citation() & (text != ""), F.concat(F.lit(label), text)).otherwise("")


def page_citations(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, citation, plain) of every page; empty where its source shows none."""
    s = sources.select(F.col("id").alias("sourceid"), F.when(has_citation(), citation()).alias("citation"), F.when(has_citation(), citation_plain()).alias("plain"))
    return pages.join(s, "sourceid", "left").select("id", F.coalesce("citation", F.lit("")).alias("citation"), F.coalesce("plain", F.lit("")).alias("plain"))


def source_counts(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, staged, in_document, pages) of every source, zeros included."""
    n = pages.groupBy(F.col("sourceid").alias("id")).agg(F.count_if("staged").alias("staged"), F.count_if(~F.col("staged")).alias("in_document"), F.count("*").alias("pages"))
    return sources.select("id").join(n, "id", "left").na.fill(0, ["staged", "in_document", "pages"])


def master_usage(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, pages, derived) of every master: pages (staged ones too) and documents made from it."""
    n = pages.groupBy(F.col("documentid").alias("id")).agg(F.count("*").alias("pages"))
    derived = documents.where("masterid IS NOT NULL").groupBy(F.col("masterid").alias("id")).agg(F.count("*").alias("derived"))
    return documents.where("ismaster").select("id").join(n, "id", "left").join(derived, "id", "left").na.fill(0, ["pages", "derived"])


def lineage(documents: DataFrame) -> DataFrame:
    """(id, masterid, known): documents made from a master, and whether it is here."""
    here = documents.select(F.col("id").alias("masterid"), F.lit(True).alias("__k"))
    return documents.where("masterid IS NOT NULL").select("id", "masterid").join(here, "masterid", "left").select("id", "masterid", F.col("__k").isNotNull().alias("known"))


def copy_sources(documents: DataFrame, grants: DataFrame, asking: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """(userid, id): masters that a user may copy from; grants (userid, course).

    With asking (userid, documentid) the answer is for that document, (userid, documentid, id): any such master but the document itself.
    It has a row for each document that asks and each master: a user's masters are dealt in ``parts`` that documents meet one by one.
    """
    may = documents.where("ismaster").select("id", "course").join(grants.select("userid", "course").distinct(), "course").select("userid", "id")
    if asking is None:
        return may
    asked = asking.select("userid", "documentid").distinct().withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.join(may.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), ["userid", "__part"]).where("id <> documentid").select("userid", "documentid", "id")


def glossary_lookup(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """(glossaryid, term, id): in each glossary that terms (glossaryid, term) ask, the lowest approved entry whose concept or alias is the term, whatever its case.

    One equi-join over both names; a term without an entry in its own glossary has no row.
    """
    ok = entries.where("approved")
    names = ok.select("glossaryid", "id", F.lower("concept").alias("name")).unionByName(ok.select("glossaryid", "id", F.lower("alias").alias("name")))
    first = names.groupBy("glossaryid", "name").agg(F.min("id").alias("id"))
    return terms.select("glossaryid", "term").distinct().withColumn("name", F.lower("term")).join(first, ["glossaryid", "name"]).select("glossaryid", "term", "id")


def recent_jobs(jobs: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Jobs shown: open ones and those changed within a day, the newest ``most`` of each document."""
    shown = jobs.where(F.col("status").isin("queued", "running") | (F.col("ts") >= now - F.expr("interval 1 day")))
    w = Window.partitionBy("documentid").orderBy(F.desc("ts"), F.desc("id"))
    return shown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs that have waited for over 10 minutes."""
    return jobs.where((F.col("status") == "queued") & (F.col("ts") < now - F.expr("interval 10 minutes")))


def listed_jobs(jobs: DataFrame, dismissed: DataFrame, now: Column) -> DataFrame:
    """Jobs that stay on the list: finished ones go when dismissed (id) or a day old, open ones stay whatever is dismissed."""
    named = dismissed.select("id").distinct().withColumn("__d", F.lit(True))
    d = jobs.join(named, "id", "left")
    final = F.col("status").isin("done", "failed")
    gone = final & (F.col("__d").isNotNull() | (F.col("ts") < now - F.expr("interval 1 day")))
    return d.where(~F.coalesce(gone, F.lit(False))).select(*jobs.columns)


def job_result(files: DataFrame) -> DataFrame:
    """files (job, file_no, pages, error) -> (job, pages, message, status): failed iff there are errors and no pages."""
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("file_no", "error")))), lambda x: x["error"]), "\n")
    out = files.groupBy("job").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), errors.alias("message"), F.count("error").alias("n"))
    return out.select("job", "pages", "message", F.when((F.col("n") > 0) & (F.col("pages") == 0), "failed").otherwise("done").alias("status"))


STATES = ("queued", "running", "failed", "done")


def job_status(jobs: DataFrame) -> DataFrame:
    """(documentid, status, jobs): each document's furthest state, done and failed being final; ties go to done."""
    rank = F.array_position(F.lit(list(STATES)), F.col("status"))
    return jobs.groupBy("documentid").agg(F.max(rank).alias("r"), F.count("*").alias("jobs")).select("documentid", F.element_at(F.lit(list(STATES)), F.col("r").cast("int")).alias("status"), "jobs")


def open_jobs(jobs: DataFrame) -> DataFrame:
    """(documentid, queued, running) of documents with open jobs."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("documentid").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))


def completion(views: DataFrame) -> DataFrame:
    """(user_id, documentid, first_view, views)."""
    return views.groupBy("user_id", "documentid").agg(F.min("ts").alias("first_view"), F.count("*").alias("views"))


def next_order(rows: DataFrame, parent: str, order: str) -> DataFrame:
    """(parent, next): the next free order number."""
    return rows.groupBy(parent).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("next"))


def changed(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the supplied (non-null) fields of changes put in."""
    fields = [c for c in changes.columns if c != key]
    d = rows.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields]), key, "left")
    return d.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
