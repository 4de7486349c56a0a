"""Packing along a space-filling curve.

Each document becomes a hashed token vector that is projected to a few dimensions; its cell on a
Hilbert curve is its place in the global order, so that neighbours in a sequence are alike. The
order is a range sort of narrow rows (key, id, token count); the token stream in that order is cut
every ``length`` tokens, so that only the last sequence can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut, written
from quire.llm.substring import byte_slices
from quire.llm.tokens import library_encoder

DIMS = 4
BUCKETS = 1 << 12


def projection(dims: int = DIMS) -> np.ndarray:
    """Fixed pseudo-random directions of the hash buckets."""
    return np.random.default_rng(5).standard_normal((BUCKETS, dims)).astype(np.float32)


def project(ids: np.ndarray, lengths: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Mean direction of each document's hashed tokens; zeros for a document without tokens."""
    out = np.zeros((len(lengths), dims), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
        starts = np.r_[0, np.cumsum(lengths[full])[:-1]]
        out[full] = np.add.reduceat(projection(dims)[bucket], starts, axis=0) / np.sqrt(lengths[full])[:, None]
    return out


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells [n, dims], each of ``bits`` bits (bits * dims < 64).

    The transposed form of the index is found by undoing, from the highest bit down, the exchanges
    and inversions of the curve; its bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenised(docs: DataFrame, id_col: str, text_col: str, end: int, path: str | None) -> DataFrame:
    """(doc_id, row, n, ids binary, p array<float>): ids of 2 or 4 bytes by vocabulary, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        tail = np.array([end], coder.width).tobytes()
        for b in byte_slices(batches, 1):
            blobs = [ids + tail for ids in coder.encode_all([t or "" for t in b.column(1).to_pylist()])]
            n = np.array([len(x) // coder.width.itemsize for x in blobs], np.int64)
            p = project(np.frombuffer(b"".join(blobs), coder.width), n) if len(n) else np.zeros((0, DIMS), np.float32)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": n, "ids": pa.array(blobs, pa.binary()), "p": pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMS).cast(pa.list_(pa.float32()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(encode, "doc_id long, n long, ids binary, p array<float>")
    return made.withColumn("row", F.monotonically_increasing_id())


def curve_starts(tokens: DataFrame, bits: int = 12) -> DataFrame:
    """(row, start): each document's place in the token stream along the curve. Only one total per partition comes to the driver."""
    spark = tokens.sparkSession
    moments = tokens.agg(*[f(F.col("p")[i]).alias(f"{k}{i}") for i in range(DIMS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([moments[f"s{i}"] or 1.0 for i in range(DIMS)])

    @F.pandas_udf("long")
    def key(p: pd.Series) -> pd.Series:
        z = (np.stack(p.to_numpy()) - mean) / np.maximum(spread, 1e-9) if len(p) else np.zeros((0, DIMS))
        cells = ((1 / (1 + np.exp(-1.7 * np.clip(z, -8, 8)))) * ((1 << bits) - 1)).astype(np.int64)  # near to the normal distribution's quantiles
        return pd.Series(hilbert_key(cells, bits))

    narrow = cut(tokens.select("row", "doc_id", "n", key("p").alias("key")))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = narrow.repartitionByRange(parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").withColumn("part", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            n = b.column(1).to_numpy()
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "n": b.column(1), "part": b.column(2), "before": so_far + np.cumsum(n) - n})
            so_far += int(n.sum())

    ordered = cut(ranged.select("row", "n", "part").mapInArrow(running, "row long, n long, part int, before long"))
    totals = dict(ordered.groupBy("part").agg(F.sum("n")).collect())
    base, at = [], 0
    for part in sorted(totals):
        base.append((part, at))
        at += totals[part]
    if not base:
        return ordered.select("row", F.col("before").alias("start"))
    offsets = spark.createDataFrame(base, "part int, base long")  # a row per partition
    return ordered.join(F.broadcast(offsets), "part").select("row", (F.col("base") + F.col("before")).alias("start"))


def pack(docs: DataFrame, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, crc: bool = False) -> DataFrame:
    """Pieces of documents in sequences: (id, start, length, ids binary, doc_tokens, sequence_id, offset).

    Every document ends with the id ``end``, so a null or empty text is one token; ids are cut freely
    and each lies in exactly one piece. Sequences are full but for the last. Rows with equal or null
    ids are packed each for itself; an empty table gives no pieces; other columns are ignored. With
    ``crc`` the crc32 of a piece's ids (as little-endian unsigned 32-bit integers) stands in their place.
    """
    tokens = written(tokenised(docs, id_col, text_col, end, path), "tokens")
    starts = curve_starts(tokens)
    width = library_encoder(path).width
    wide = width.itemsize

    kind = "ids_crc32 long" if crc else "ids binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column("at").to_numpy(), b.column("n").to_numpy()
            first, last = at // length, (at + n - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            lo = np.maximum(at[row], seq * length)
            hi = np.minimum((at + n)[row], (seq + 1) * length)
            blobs = [b.column("ids")[i].as_py() for i in range(len(n))]
            start = lo - at[row]
            ids = [blobs[r][s * wide : e * wide] for r, s, e in zip(row.tolist(), start.tolist(), (hi - at[row]).tolist())]
            if crc:
                last = pa.array([zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in ids], pa.int64())
            else:
                last = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(row)), "start": start, "length": hi - lo, kind.split()[0]: last, "doc_tokens": n[row], "sequence_id": seq, "offset": lo - seq * length})

    placed = tokens.select("row", "doc_id", "n", "ids").join(starts.withColumnRenamed("start", "at"), "row").drop("row")
    out = placed.mapInArrow(pieces, f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pieces of :func:`pack` with the crc32 of their ids in place of the ids; edge cases are those of pack."""
    return pack(docs, id_col=id_col, text_col=text_col, path=path, crc=True)
