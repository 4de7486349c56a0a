"""Tables of a run in the folder that driver and executors share, and the size of what Python workers and tasks get at once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, one of our own in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-quire-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of this run in the shared folder, read back (columnar, compressed, prunable)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 1 << 22) -> None:
    """Python workers of this session get ``most`` bytes of rows at once and no more (of one row, its size); a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(name, f"{most}b")


def small_tasks(spark: SparkSession, most: int = 1 << 23, first: int = 1000) -> None:
    """Tasks of this session behind a shuffle read about ``most`` bytes of it; a smaller setting stays, and one that can't be read as well.

    Rows grow twenty-fold where they are sorted, so a task of 64 MB needs gigabytes or spills. Partitions are joined up to this
    size, so there are ``first`` of them to begin with (a given number of them stays): memory of a task doesn't grow with the input.
    """
    size, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(size).lower())
    if m and int(m[1]) << 10 * " kmgt".index(m[2] or " ") > most:
        spark.conf.set(size, f"{most}b")
    if spark.conf.get(number, None) is None and int(spark.conf.get("spark.sql.shuffle.partitions")) < first:
        spark.conf.set(number, str(first))
