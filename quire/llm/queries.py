"""The registered queries of the training-data operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, flac, hard_negatives, packing, prefix_hashes, quality, rans, resampling, secret_scan, simhash, substring, toxicity, url_filter
from quire.llm.oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component; edge cases are those of near_duplicates."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with what is left of its words; edge cases are those of remove_repeats."""
    return substring.digests(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the digests of its ids and of the decoded text; edge cases are those of bpe.digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score; null and empty texts, repeated rows and empty tables as in toxicity.score, the training rows as in toxicity.fit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its spans; null, empty and long texts, repeated rows and empty tables as in secret_scan.find_spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    n = lambda kind: F.size(F.filter("secret_spans", lambda x: x["k"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("secret_spans")).alias("spans"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the digests of its stream; edge cases are those of flac.encode."""
    return flac.digests(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of documents in sequences; edge cases are those of packing.pack."""
    return packing.digests(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its measures and verdict; edge cases are those of quality.judge."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with its rule and verdict; edge cases are those of url_filter.judge."""
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as its ids came back from the files; edge cases are those of rans.digests."""
    return rans.digests(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its weight towards benchmark and its rank in the sample; edge cases are those of resample."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and its edited text's as hexadecimal digits; edge cases are those of compared."""
    found = prefix_hashes.compared(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose id is divisible by 50; edge cases are those of hard_negatives."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, "vec_id % 50 = 0")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_secrets": op2_secrets, "op3_simhash": op3_simhash, "op4_flac": op4_flac, "op5_packing": op5_packing, "op6_quality": op6_quality, "op7_substring": op7_substring, "op8_bpe": op8_bpe, "op9_urls": op9_urls, "op10_rans": op10_rans, "op11_resampling": op11_resampling, "op12_prefix_hashes": op12_prefix_hashes, "op13_hard_negatives": op13_hard_negatives}
