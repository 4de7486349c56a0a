"""Streams: files that arrive, job states, view events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.provenance import STATES
from quire.sources.scan import route

FILES = "path string, modificationTime timestamp, length long, content binary"


def import_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)


def put_epoch(rows: DataFrame, epoch: int, folder: str) -> None:
    """rows as the part of a Parquet folder that belongs to one batch: a batch that runs again replaces its own part and nothing else."""
    rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)


def write_imports(files: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """Routes each batch: accepted files and rejected ones (with messages) are written once for each batch, however often it runs; a bad file never fails the batch."""
    return files.writeStream.foreachBatch(imports_batch(accepted, rejected)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imports_batch(accepted: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """What write_imports does with a batch."""

    def batch(rows: DataFrame, epoch: int) -> None:
        good, bad = route(rows)
        put_epoch(good.select("path", "filename", "sourcetype", "title", "length"), epoch, accepted)
        put_epoch(bad.select("path", "filename", "message"), epoch, rejected)

    return batch


def _furthest(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rank = state.get[0] if state.exists else -1
    for b in batches:
        new = max(map(STATES.index, b["status"]), default=-1)
        if rank < STATES.index("failed"):  # done and failed are final
            rank = max(rank, new)
    state.update((rank,))
    yield pd.DataFrame({"id": [key[0]], "status": [STATES[rank]]})


def job_states(events: DataFrame) -> DataFrame:
    """events (id, status) -> (id, status) after each batch; a final state stays whatever comes later."""
    return events.groupBy("id").applyInPandasWithState(_furthest, "id long, status string", "rank int", "update", GroupStateTimeout.NoTimeout)


JOBS = "id long, status string, at timestamp"


def job_watch(events: DataFrame, stale: str = "10 minutes", forget: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """events (id, status, ts) -> (id, status, at): what happens to import jobs, with timers in event time.

    status of an event is queued, running, done, failed, or the command dismiss. A row comes out for each state a job
    reaches, stale once it has been queued for over ``stale``, forgotten when it has been finished for
    ``forget`` and dismissed when a command takes a finished job off the list; a dismiss of an open job does
    nothing. done and failed are final. Timers fire when the watermark (``late`` behind the last event)
    passes them; state goes when a job is forgotten or dismissed, and an event that names it later begins it anew. Rows
    without an id, a time or a known status are left out.
    """
    import datetime

    known = [*STATES, "dismiss"]
    wait, keep = (pd.Timedelta(x.replace("minutes", "min")) // pd.Timedelta("1ms") for x in (stale, forget))
    stamp = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).replace(tzinfo=None)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, (rank, since, told) = [], state.get if state.exists else (-1, 0, False)
        if state.hasTimedOut:
            if rank >= STATES.index("failed"):
                out.append((key[0], "forgotten", stamp(since + keep)))
                state.remove()
            else:
                out.append((key[0], "stale", stamp(since + wait)))
                state.update((rank, since, True))
        else:
            rows = [(int(t), known.index(s), s) for b in batches for s, t in zip(b["status"], b["ms"])]
            gone = False
            for t, _, status in sorted(rows):
                if status == "dismiss":
                    if rank >= STATES.index("failed"):
                        out.append((key[0], "dismissed", stamp(t)))
                        gone = True
                        rank = -1
                elif rank < STATES.index("failed") and STATES.index(status) > rank:
                    rank, since, told, gone = STATES.index(status), t, False, False
                    out.append((key[0], status, stamp(t)))
            if gone or rank < 0:
                if state.exists:
                    state.remove()
            else:
                state.update((rank, since, told))
                ends = since + (keep if rank >= STATES.index("failed") else wait)
                if rank >= STATES.index("failed") or rank == STATES.index("queued") and not told:
                    state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": pd.Series([r[0] for r in out], dtype="int64"), "status": [r[1] for r in out], "at": pd.to_datetime(pd.Series([r[2] for r in out], dtype="datetime64[ns]"))})

    rows = events.select(F.col("id").cast("long").alias("id"), "status", F.col("ts").cast("timestamp").alias("ts")).where(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(known))
    rows = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("id").applyInPandasWithState(step, JOBS, "rank int, since long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def first_views(views: DataFrame, late: str = "1 hour") -> DataFrame:
    """views (user_id, documentid, ts): the first event of each user and document within the watermark."""
    return views.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "documentid"])


def view_counts(views: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(documentid, window start, views) per time window."""
    n = views.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("documentid", F.window("ts", window)).agg(F.count("*").alias("views"))
    return n.select("documentid", F.col("window.start").alias("start"), "views")


def open_job_counts(events: DataFrame) -> DataFrame:
    """(documentid, open) over all events so far (complete output)."""
    return events.groupBy("documentid").agg(F.count_if(F.col("status").isin("queued", "running")).alias("open"))


def incremental_reflow(changes: DataFrame, reflow: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Each batch's distinct sources are set again by reflow(ids); :func:`staged_pages` reads what is valid."""
    return changes.writeStream.foreachBatch(reflow_batch(reflow, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reflow_batch(reflow: Callable[[DataFrame], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """What incremental_reflow does with a batch: its pages first, then the list of its sources, which makes them valid."""

    def batch(rows: DataFrame, epoch: int) -> None:
        ids = rows.select("sourceid").where("sourceid IS NOT NULL").distinct()
        put_epoch(reflow(ids), epoch, f"{target}/pages")
        put_epoch(ids, epoch, f"{target}/sources")

    return batch


def staged_pages(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame:
    """The pages of each source's last batch; a source that was set again without any page has none.

    schema names the pages' columns; without it they are read from the files, of which there must be one.
    """
    last = spark.read.parquet(f"{target}/sources").groupBy("sourceid").agg(F.max("epoch").alias("epoch"))
    pages = spark.read.schema(f"{schema}, epoch int") if schema else spark.read
    return pages.parquet(f"{target}/pages").join(last, ["sourceid", "epoch"], "left_semi").drop("epoch")
