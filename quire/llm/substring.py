"""Exact repeats across documents, found by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; the block hashes go
into an index of fixed size. Every rolling window of a block's length then probes the index, so a
repeat of a whole window always meets an aligned block of either document. Blocks that the probes
find in two documents at least are the anchors; around them hits are extended: the hash of each full
window that holds an anchor is sent with its smallest and largest document of a batch, and places are
sent only of windows that two documents have, to be compared with the smallest document; the windows
of later documents cover maximal repeats. Of equal texts only the first one is searched.

The index is a bit filter of a fixed size (a parameter), which is why it can be broadcast at any
input size: it has no false negatives, and what it lets through in excess is dropped by the exact
grouping that follows, so that a filter that is too small costs shuffle, never results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.tables import small_batches
from quire.llm.store import cut, fresh, written

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = {"n": 0}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _TABLE["n"] < n or not n:
        size = max(1 << 14, 1 << n.bit_length())
        _TABLE.update(n=size, up=_powers(BASE, size), down=_powers(INVERSE, size))
    return _TABLE["up"], _TABLE["down"]


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words (none if there are fewer), from prefix sums modulo 2 ** 64."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = _table(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    x = (sums[width:] - sums[:-width]) * down[: len(h) - width + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash the word of the filter and the four bits there."""
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (h >> np.uint64(64 - (bits - 6))).astype(np.int64), mask


class Filter:
    """A blocked bit filter of 2 ** bits bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, h) -> bool:
        raise TypeError("ask has() about an array")

    def has(self, h: np.ndarray) -> np.ndarray:
        slot, mask = _slots(h, self.bits)
        return (self.words[slot] & mask) == mask


def build_filter(spark: SparkSession, hashes: DataFrame, bits: int) -> Broadcast:
    """Filter of a column ``h`` of hashes: bits are merged per filter word on the executors, at most 2 ** (bits - 6) words come back."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, mask = _slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield pa.RecordBatch.from_pydict({"slot": slot.astype(np.int32), "mask": mask.view(np.int64)})

    got = hashes.select("h").where("h is not null").mapInArrow(words, "slot int, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask"))
    table, out = got.toArrow(), np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Filter(out, bits))


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut into stretches with about ``most`` bytes in a text column, which bounds a worker's memory."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)))
            yield b.slice(lo, hi - lo)
            lo = hi


def _per_text(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        yield doc, key, word_hashes(split_words(text.as_py()))


def _joined(parts: list[np.ndarray], dtype=np.uint64) -> np.ndarray:
    return np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)


def _ends(hashes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Of each hash of a batch its smallest and largest document."""
    h, d = _joined(hashes), _joined(ids, np.int64)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    last = np.r_[first[1:] - 1, len(h) - 1] if len(h) else first
    return _rows(h=h[first].view(np.int64), lo=d[first], hi=d[last])


def repeated_windows(docs: DataFrame, window: int = 50, bits: int = 27, named: Broadcast | None = None) -> DataFrame:
    """docs (doc_id, key, text) -> (key, at): starts of windows whose words also start in a document with a smaller id. named: a filter of the keys of rows that take part."""
    spark, block = docs.sparkSession, window // 2
    small_batches(spark)
    docs = docs.select("doc_id", "key", "text")

    def texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """Rows with a whole window and an id."""
        keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if named is not None:
            b = b.filter(pa.array(named.value.has(keys)))
        return ((doc, key, h) for doc, key, h in _per_text(b) if len(h) >= window and doc is not None)

    def aligned(batches):
        for b in byte_slices(batches, 2):
            yield _rows(h=np.unique(_joined([rolling(h, block)[::block] for _, _, h in texts(b)])).view(np.int64))

    index = build_filter(spark, docs.mapInArrow(aligned, "h long"), bits)

    def probed(batches):
        for b in byte_slices(batches, 2):
            hashes, ids = [], []
            for doc, _, h in texts(b):
                r = rolling(h, block)
                r = np.unique(r[index.value.has(r)])
                hashes.append(r)
                ids.append(np.full(len(r), doc, np.int64))
            yield _ends(hashes, ids)

    def shared(rows):
        return rows.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")

    anchors = build_filter(spark, shared(docs.mapInArrow(probed, "h long, lo long, hi long")), bits)

    def around(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows that hold an anchor, and their hashes."""
        hit = anchors.value.has(rolling(h, block))
        if not hit.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        count = np.r_[0, np.cumsum(hit)]
        span = window - block + 1  # anchors that start in a window
        starts = np.flatnonzero(count[span:] > count[:-span])
        return starts, rolling(h, window)[starts]

    def seen(batches):
        for b in byte_slices(batches, 2):
            hashes, ids = [], []
            for doc, _, h in texts(b):
                hashes.append(np.unique(around(h)[1]))
                ids.append(np.full(len(hashes[-1]), doc, np.int64))
            yield _ends(hashes, ids)

    # places are shuffled only of windows that two documents have; the texts are read once more for that
    first = written(shared(docs.mapInArrow(seen, "h long, lo long, hi long")).select("h", "lo"), "windows")
    repeats = build_filter(spark, first, bits)

    def extended(batches):
        for b in byte_slices(batches, 2):
            hashes, ids, keys, at = [], [], [], []
            for doc, key, h in texts(b):
                starts, found = around(h)
                twice = repeats.value.has(found)
                starts = starts[twice]
                hashes.append(found[twice])
                at.append(starts)
                ids.append(np.full(len(starts), doc, np.int64))
                keys.append(np.full(len(starts), key, np.int64))
            yield _rows(h=_joined(hashes).view(np.int64), doc_id=_joined(ids, np.int64), key=_joined(keys, np.int64), at=_joined(at, np.int32))

    held = docs.mapInArrow(extended, "h long, doc_id long, key long, at int")
    return held.join(first, "h").where("doc_id > lo").select("key", "at")


ALL = -1  # in place of a start: the whole text is a copy of an earlier one


def repeated_starts(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """:func:`repeated_windows`, and (key, ALL) of copies: a text with an equal one under a smaller id repeats in all its windows.

    Only the first text of equal ones takes part in the search, which finds the same windows by it. (A copy that the filter
    of their keys lets through is searched as well, without a change.)
    """
    rows = cut(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", F.sha2("text", 256).alias("same")))
    many = rows.groupBy("same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    found = rows.join(many, "same", "left")
    firsts = build_filter(docs.sparkSession, found.where("lo IS NULL OR doc_id = lo").select(F.col("key").alias("h")), bits)
    copies = found.where("doc_id > lo").select("key", F.lit(ALL).alias("at"))
    return repeated_windows(docs, window, bits, firsts).unionByName(copies)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _applied(docs: DataFrame, window: int, bits: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """docs with (n_words, n_removed, kept): the kept text, or with digest the SHA-256 of its single-spaced words."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    mine = {n: fresh(n, docs) for n in ("__key", "__maybe", "__at")}
    docs = docs.select(*names, F.xxhash64(F.col(id_col), F.col(text_col)).alias(mine["__key"]))
    starts = repeated_starts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(mine["__key"]).alias("key"), F.col(text_col).alias("text")), window, bits)
    ranges = cut(starts.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at")))
    some = build_filter(spark, ranges.select(F.xxhash64("key").alias("h")), min(bits, 26))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(some.value.has(h.to_numpy().view(np.uint64)))

    text_at, at_at = [n.lower() for n in names].index(text_col.lower()), len(names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices([whole], text_at):
                n_words, n_removed, last = [], [], []
                for text, starts_ in zip(b.column(text_at), b.column(at_at)):
                    text = text.as_py()
                    words, removed = split_words(text), 0
                    kept = words
                    if starts_.is_valid and len(starts_):
                        places = starts_.values.to_numpy().astype(np.int64)
                        gone = np.full(len(words), len(words) >= window) if places[0] == ALL else covered(places, len(words), window)
                        removed, kept = int(gone.sum()), [w for w, g in zip(words, gone.tolist()) if not g]
                    n_words.append(len(words))
                    n_removed.append(removed)
                    if digest:
                        last.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    else:
                        last.append(b" ".join(kept).decode("utf-8", "surrogatepass") if removed else text or "")
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(last, pa.string())], names=[*b.schema.names[:-1], "n_words", "n_removed", "kept"])

    # texts that surely keep all their words are not shuffled
    flagged = docs.withColumn(mine["__maybe"], maybe(F.xxhash64(mine["__key"])))
    plain = flagged.where(~F.col(mine["__maybe"])).withColumn(mine["__at"], F.lit(None).cast("array<int>"))
    hit = flagged.where(F.col(mine["__maybe"])).join(ranges.select(F.col("key").alias(mine["__key"]), F.col("at").alias(mine["__at"])), mine["__key"], "left")
    every = plain.select(*names, mine["__at"]).unionByName(hit.select(*names, mine["__at"]))
    schema = T.StructType([*every.select(*names).schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    return every.mapInArrow(apply, schema)


def remove_repeats(docs: DataFrame, window: int = 50, bits: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with (n_words, n_removed, kept): every word covered by a repeated window is taken out.

    A window is repeated if its words also start in a document with a smaller id, judged on the
    input. kept is the remaining words joined by one space, or the text as it is (null: empty)
    where nothing goes. A null or short text keeps all words; rows with a null id neither lose words
    nor count as earlier documents; repeated rows are judged alike. Texts of any length are read whole; an empty
    table gives no rows. Existing columns stay, except those that are named like the new ones.
    """
    return _applied(docs, window, bits, id_col, text_col, False)


def digests(docs: DataFrame, window: int = 50, bits: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of :func:`remove_repeats`, kept words joined by one space."""
    found = _applied(docs.select(id_col, text_col), window, bits, id_col, text_col, True)
    return found.select(id_col, "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
