"""Importance resampling towards a target corpus, with features counted by distinct lines.

Features are hashed runs of words. No word crosses a line, so texts are cut into lines first: equal
lines of the whole corpus meet, each distinct line is cut into features once and its counts are
multiplied by its occurrences; runs of words that cross lines are counted from the texts and added.
A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus; a document
weighs the sum of its gains, and Gumbel noise drawn from its id turns the highest scores into a
sample by weight, without repeats.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import written
from quire.llm.substring import byte_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes between words become blanks, A-Z become a-z; bytes of other letters stay.
PLAIN = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
KEPT = 500_000  # features that a worker remembers
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def runs(w: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by one space."""
    return list(chain(w, *(map(b" ".join, zip(*(w[i:] for i in range(n)))) for n in range(2, longest + 1))))


def crossing(lines: list[list[bytes]], longest: int) -> list[bytes]:
    """The runs of a text's words that lie in more than one of its lines."""
    w = list(chain(*lines))
    ends = np.cumsum([len(x) for x in lines])
    borders = np.unique(ends[(ends > 0) & (ends < len(w))])
    out = []
    for n in range(2, longest + 1):
        starts = np.unique((borders[:, None] - np.arange(1, n)).ravel())
        out += [b" ".join(w[i : i + n]) for i in starts[(starts >= 0) & (starts + n <= len(w))].tolist()]
    return out


class _Counts:
    """Feature counts by bucket; features are hashed once while they are remembered."""

    def __init__(self, buckets: int):
        self.sums, self.seen = np.zeros(buckets, np.int64), Counter()

    def add(self, features: list[bytes], times: int = 1) -> None:
        if times == 1:
            self.seen.update(features)
        else:
            for f, n in Counter(features).items():
                self.seen[f] += n * times
        if len(self.seen) > KEPT:
            self.settle()

    def settle(self) -> None:
        at = np.fromiter(map(zlib.crc32, self.seen), np.int64, len(self.seen)) % len(self.sums)
        np.add.at(self.sums, at, np.fromiter(self.seen.values(), np.int64, len(self.seen)))
        self.seen.clear()

    def batch(self) -> pa.RecordBatch:
        self.settle()
        at = np.flatnonzero(self.sums)
        return pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": self.sums[at]})


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(line, n): the distinct lines with a word in them, A-Z lower-cased, and how often they occur; pre-aggregated in every task."""
    lines = docs.select(F.explode(F.split(F.translate(text_col, UPPER, LOWER), "\n")).alias("line"))
    return lines.where(F.col("line").rlike(WORD)).groupBy("line").agg(F.count("*").alias("n"))


def feature_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 1, text_col: str = "text") -> np.ndarray:
    """Counts by bucket of all features of all texts; at most ``buckets`` sums come to the driver."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for b in batches:
            for line, n in zip(b.column(0), b.column(1).to_pylist()):
                counts.add(runs(words(line.as_py()), longest), n)
        yield counts.batch()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for b in byte_slices(batches, 0):
            for text in b.column(0):
                counts.add(crossing([words(x) for x in (text.as_py() or "").split("\n")], longest))
        yield counts.batch()

    found = line_counts(docs, text_col).mapInArrow(inside, "bucket int, n long")
    if longest > 1:
        found = found.unionByName(docs.select(text_col).mapInArrow(across, "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * ln of its smoothed share in the target over that in the source)."""
    s_all, t_all, n = float(source.sum()) + len(source), float(target.sum()) + len(source), len(source)
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s_all / ((float(source[i]) + 1) * t_all))) for i in range(n)], np.int64)


class _Gains(dict):
    """Gain of a feature; hashed when it is met first."""

    def __init__(self, of: list[int]):
        self.of = of

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = self.of[zlib.crc32(feature) % len(self.of)]
        return found


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; weight is the sum of its features' gains."""
    of = gain.tolist()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Gains(of)
        for b in byte_slices(batches, 1):
            n_words, n_features, weight = [], [], []
            for text in b.column(1):
                w = words(text.as_py())
                f = w if longest == 1 else runs(w, longest)
                n_words.append(len(w))
                n_features.append(len(f))
                weight.append(sum(map(known.__getitem__, f)))
                if len(known) > KEPT:
                    known.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weight, pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored (doc_id, score, ...) with rank 1 to ``drawn`` of the highest scores, ties to the smaller id; null for the others.

    Rows are range sorted and numbered by partition; one count for each partition comes to the driver.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), "ranked")
    base, at = [], 1
    for part, n in sorted(placed.groupBy("__part").count().collect()):
        base.append((part, at - (part << 33)))
        at += n
    offsets = scored.sparkSession.createDataFrame(base or [(0, 1)], "__part long, __base long")
    rank = F.col("__base") + F.col("__at")
    return placed.join(F.broadcast(offsets), "__part").withColumn("rank", F.when(rank <= drawn, rank)).drop("__part", "__at", "__base")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """(id, n_features, weight, score, rank), a row for each row of docs; rank 1, 2, 3 ... marks the drawn ones.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: those with the
    highest scores, ties to the smaller id. score is weight plus floor(-1000 * ln(-ln(u))), u drawn
    from sha256 of ``seed:id``; a null id is drawn like an empty one. A null or wordless text has no features and
    weight 0. Repeated rows are rows of their own with equal scores, and which of them comes first
    doesn't show. Lines and texts of any length are read whole. An empty table gives no rows, an
    empty target or corpus a share of 1 / buckets everywhere. Other columns are not looked at.
    """
    gain = gains(feature_counts(docs, buckets, longest, text_col), feature_counts(target, buckets, longest, target_col))
    drawn_from = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((drawn_from + 0.5) / 4294967296))).cast("long")
    scored = weighed(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    enough = F.col("n_words") >= least_words
    out = ranked(scored.where(enough), percent * scored.where(enough).count() // 100).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
