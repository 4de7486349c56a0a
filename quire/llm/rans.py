"""Token ids in files of static range asymmetric numeral system blocks.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole
documents; its tokens are dealt out to interleaved lanes that share a stream of 32-bit words. Every
``CHECKPOINT`` steps the lanes' states and the place in the stream are kept, so that the parts of a
block decode at once, and a block's checksum is verified when it is read. Blocks are independent of
each other; they are the rows of a Parquet folder, beside the table and the totals of the shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.store import shared_dir, written
from quire.llm.tokens import library_encoder

SCALE = 20  # frequencies sum up to 2 ** SCALE
LOW = np.uint64(1 << 31)  # states lie in [2 ** 31, 2 ** 63)
LANES = 32
CHECKPOINT = 256  # steps between checkpoints
BLOCK = 32_768  # a block is closed when it has this many tokens
TEXTS = 500  # texts that are encoded at once
GROUP = 64  # blocks that are coded or decoded in step
MAGIC = b"QRA1"


class Table:
    """Frequencies of all ids, scaled so that every id can be encoded."""

    def __init__(self, counts: np.ndarray):
        room = (1 << SCALE) - len(counts)
        if room < 0:
            raise ValueError("the vocabulary is larger than the scale")
        f = 1 + (counts.astype(object) * room // max(1, int(counts.sum()))).astype(np.int64)
        f[int(counts.argmax())] += (1 << SCALE) - int(f.sum())
        self.freq = f.astype(np.uint64)
        self.cum = np.r_[0, np.cumsum(f)[:-1]].astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(f)), f).astype(np.uint32)
        self.common = int(f.argmax())


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Payloads of blocks of ids, all lanes of all blocks in step."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    steps = np.array([-(-len(blocks[i]) // LANES) for i in order])
    top = int(steps.max(initial=0))
    sym = np.full((len(order), top, LANES), table.common, np.uint32)
    for r, i in enumerate(order):
        sym[r].reshape(-1)[: len(blocks[i])] = blocks[i]
    x = np.full((len(order), LANES), LOW, np.uint64)
    need = np.zeros((top, len(order), LANES), bool)
    word = np.zeros((top, len(order), LANES), np.uint32)
    kept = np.zeros((-(-top // CHECKPOINT), len(order), LANES), np.uint64)
    for t in range(top - 1, -1, -1):
        k = int(np.searchsorted(-steps, -t, "left"))  # blocks with more than t steps
        s, y = sym[:k, t], x[:k]
        f = table.freq[s]
        full = y >= f << np.uint64(43)
        need[t, :k], word[t, :k] = full, y.astype(np.uint32)
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:k] = (q << np.uint64(SCALE)) + (y - q * f) + table.cum[s]
        if t % CHECKPOINT == 0:
            kept[t // CHECKPOINT, :k] = x[:k]
    out = [b""] * len(blocks)
    for r, i in enumerate(order):
        mine = need[: steps[r], r]
        words = word[: steps[r], r][mine]
        places = np.r_[0, np.cumsum(mine.sum(1))][: steps[r] : CHECKPOINT].astype("<u4")
        states = kept[: len(places), r].astype("<u8")
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        head = MAGIC + struct.pack("<IIII", len(blocks[i]), len(places), len(words), crc)
        out[i] = head + places.tobytes() + states.tobytes() + words.astype("<u4").tobytes()
    return out


def decode_blocks(payloads: list[bytes], table: Table) -> list[np.ndarray]:
    """Ids of blocks; raises ValueError where a block is no block or its checksum differs."""
    heads, segments, words, base = [], [], [], 0
    for p in payloads:
        if p[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n, parts, size, crc = struct.unpack_from("<IIII", p, 4)
        places = np.frombuffer(p, "<u4", parts, 20)
        states = np.frombuffer(p, "<u8", parts * LANES, 20 + 4 * parts).reshape(parts, LANES)
        words.append(np.frombuffer(p, "<u4", size, 20 + 4 * parts + 8 * LANES * parts))
        steps = -(-n // LANES)
        heads.append((n, parts, crc))
        segments.append((states, base + places.astype(np.int64), np.minimum(CHECKPOINT, steps - np.arange(parts) * CHECKPOINT)))
        base += size
    if not heads:
        return []
    x = np.concatenate([s[0] for s in segments]).astype(np.uint64)
    at = np.concatenate([s[1] for s in segments])
    steps = np.concatenate([s[2] for s in segments])
    stream = np.r_[np.concatenate(words), np.zeros(1, np.uint32)].astype(np.uint64)
    order = np.argsort(-steps, kind="stable")
    x, at, sorted_steps = x[order], at[order], steps[order]
    out = np.zeros((len(steps), CHECKPOINT, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(int(sorted_steps.max(initial=0))):
        k = int(np.searchsorted(-sorted_steps, -t, "left"))
        y = x[:k]
        slot = y & mask
        s = table.of_slot[slot]
        y = table.freq[s] * (y >> np.uint64(SCALE)) + slot - table.cum[s]
        need = y < LOW
        rank = np.cumsum(need, axis=1)
        place = np.minimum(at[:k, None] + rank - 1, len(stream) - 1)
        x[:k] = np.where(need, y << np.uint64(32) | stream[place], y)
        at[:k] += rank[:, -1]
        out[:k, t] = s
    whole = np.empty_like(out)
    whole[order] = out
    result, seg = [], 0
    for n, parts, crc in heads:
        ids = whole[seg : seg + parts].reshape(-1)[:n]
        seg += parts
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        result.append(ids)
    return result


def _blocks(end: int, path: str | None, block: int):
    """Texts of a partition, in order -> rows of blocks; offsets count from the partition's first token."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        tail = np.array([end], coder.width).tobytes()
        so_far, number, part = 0, 0, 0
        docs, lengths, blobs, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int64()), "first": [so_far], "n": [size], "docs": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "ids": pa.array([b"".join(blobs)], pa.binary())})

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                coded = coder.encode_all([t or "" for t in some.column(1).to_pylist()])
                for doc, ids, p in zip(some.column(0).to_pylist(), coded, some.column(2).to_pylist()):
                    part = p
                    docs.append(doc)
                    lengths.append(len(ids) // coder.width.itemsize + 1)
                    blobs += [ids, tail]
                    size += lengths[-1]
                    if size >= block:
                        yield row()
                        so_far, number, docs, lengths, blobs, size = so_far + size, number + 1, [], [], [], 0
        if docs:
            yield row()

    return make


def _counts(width: np.dtype, vocabulary: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for ids in b.column(0):
                n += np.bincount(np.frombuffer(ids.as_buffer(), width), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": at.astype(np.int32), "n": n[at]})

    return count


def write(docs: DataFrame, folder: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK) -> None:
    """Writes all documents, in ascending order of their ids, to a new folder with blocks/, table/ and shards/.

    Each document's ids end with ``end``; a null text has only that. Null ids come first, equal ids
    in the order of their texts' hashes. An empty table gives empty files.
    """
    spark, coder = docs.sparkSession, library_encoder(path)
    width, vocabulary = coder.width, coder.whole.get_vocab_size()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = "part int, block long, first long, n long, docs array<long>, lengths array<long>, ids binary"
    tokens = written(ranged.mapInArrow(_blocks(end, path, block), schema), "blocks")
    got = tokens.select("ids").mapInArrow(_counts(width, vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id of the vocabulary at most
    counts = np.zeros(vocabulary, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    table = spark.sparkContext.broadcast(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(table.value)
        for b in batches:
            ids = b.column(6)
            for at in range(0, len(ids), GROUP):
                chosen = [np.frombuffer(ids[i].as_buffer(), width) for i in range(at, min(at + GROUP, len(ids)))]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(chosen)).columns[:6], pa.array(encode_blocks(chosen, shared), pa.binary())], names=[*b.schema.names[:6], "payload"])

    tokens.mapInArrow(encode, schema.replace("ids binary", "payload binary")).write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(counts.tobytes(),)], "counts binary").write.parquet(f"{folder}/table")
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): every document of a folder, ids as little-endian unsigned 32-bit integers.

    Blocks decode on their own; only the frequency table and one total per shard come to the driver.
    A folder of an empty table gives no rows; null and repeated ids come back as they were written.
    """
    return _read(spark, folder, "ids binary", lambda raw: raw, pa.binary())


def _read(spark: SparkSession, folder: str, last: str, of_ids: Callable, kind: pa.DataType) -> DataFrame:
    """read() with of_ids(bytes of a document's ids) as its last column."""
    first = spark.read.parquet(f"{folder}/table").first()
    shared = spark.sparkContext.broadcast(first["counts"])
    totals = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{folder}/shards").collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shared.value, np.int64))
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                rows = b.slice(lo, GROUP).to_pylist()
                docs, starts, lengths, blobs = [], [], [], []
                for row, ids in zip(rows, decode_blocks([r["payload"] for r in rows], table)):
                    ends = np.cumsum(row["lengths"])
                    begin = ends - row["lengths"]
                    docs += row["docs"]
                    lengths += row["lengths"]
                    starts += (begin + row["first"] + base[row["part"]]).tolist()
                    raw = ids.astype("<u4").tobytes()
                    blobs += [of_ids(raw[4 * s : 4 * e]) for s, e in zip(begin.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", last.split()[0]])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32), written to a new folder in the shared directory and read back from there.

    A row for each row of docs, null and repeated ids included; a null or empty text is its end id
    alone; texts are coded whole; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/quire-tables/tokens-{uuid.uuid4().hex}"
    write(docs, folder, id_col=id_col, text_col=text_col, path=path)
    return _read(spark, folder, "ids_crc32 long", zlib.crc32, pa.int64()).withColumnRenamed("doc_id", id_col)
