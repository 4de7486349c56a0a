"""Corpus pipeline: documents through five of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before has kept. All
but the last give the columns of documents, with n_chars brought up to date where texts change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import packing, secret_scan, simhash, substring, toxicity
from quire.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, as they are."""
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, scorer).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (then text hash); of repeated rows one.

    Rows without an id stay. Different texts that share an id are different rows: one goes only if
    it is a near copy of another. An empty table gives no rows; columns beside COLUMNS are dropped.
    """
    docs = docs.select(*COLUMNS)
    first = simhash.near_copies(docs.select("doc_id", "text")).where("first AND doc_id IS NOT NULL").select("doc_id", "hashed").distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn("hashed", F.xxhash64("text")).join(first, ["doc_id", "hashed"], "left_semi")
    return named.dropDuplicates(["doc_id", "hashed"]).select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document with a smaller id has; no document goes."""
    clean = substring.remove_repeats(docs, window=50)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return clean.withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    marked = secret_scan.redact(secret_scan.scan(docs))
    return marked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with the checksum of each piece's ids."""
    return packing.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the scores nor the sequences; tests/llm compares the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
