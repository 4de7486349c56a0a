"""Hard negatives by exact integer scores from residue-number-system matrix products.

Vectors are scaled and floored to integers. Their matrices are multiplied modulo several small primes
in float32, where every sum stays under 2 ** 24 and so is exact; the residues are put together by
Chinese remaindering in balanced mixed radix, which gives the signed score itself. Primes are added
until their product passes four times the largest score that the rows' lengths allow.

Anchors are a stated set of query rows against all rows. They are numbered and taken in blocks of a
fixed size, each broadcast to tasks that stream over the rows: one pass finds the anchors' positives,
whose scores set the windows, a second one the negatives inside them. A task keeps the best few of
each anchor, and these are merged by a window of the anchor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.store import shared_dir, written

EXACT = 1 << 24  # integers up to here are exact in float32
INNER = 4096  # components that are multiplied before residues are taken again
WIDEST = 1 << 55  # 95 times a score must fit in a long
BLOCK_BYTES = 32 << 20  # vectors of a block of anchors
TILE = 512, 2048  # anchors and rows whose scores are held at once
LEAST = np.iinfo(np.int64).min


def moduli(dims: int, bound: int) -> list[int]:
    """Odd primes, the largest first, under which sums of ``dims`` products are exact, with a product over 4 * bound."""
    inner, found, product = max(1, min(dims, INNER)), [], 1
    p = 2047
    while product <= 4 * bound or not found:
        if inner * ((p - 1) // 2) ** 2 <= EXACT and all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo p as float32 between -p / 2 and p / 2."""
    return ((x + p // 2) % p - p // 2).astype(np.float32)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


class Residues:
    """Integer rows as residue matrices of each modulus."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(rows, p) for p in primes]

    def scores(self, other: Residues, mine: slice = slice(None), theirs: slice = slice(None)) -> np.ndarray:
        """Inner products of my rows with the other's rows, as int64: exact where they are under a quarter of the moduli's product."""
        digits, out, weight = [], None, 1
        for p, a, b in zip(self.primes, self.parts, other.parts):
            a, b, t = a[mine], b[theirs], None
            for at in range(0, max(1, a.shape[1]), INNER):
                part = _centred(a[:, at : at + INNER] @ b[:, at : at + INNER].T, p)
                t = part if t is None else _centred(t + part, p)
            for q, d in zip(self.primes, digits):  # Garner's digits of the balanced mixed radix
                t = _centred((t - d) * residues(np.array(pow(q, -1, p)), p), p)
            digits.append(t)
            out = t.astype(np.int64) if out is None else out + t.astype(np.int64) * weight
            weight *= p
        return out


def vectors(rows: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v array<long>): rows that take part, components floor(scale * x) in doubles; repeated rows once."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    d = d.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where("forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity'))")  # NaN is greater
    return d.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")).distinct()


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The column v as a matrix; shorter rows end in zeros."""
    v = batch.column(batch.schema.get_field_index("v"))
    flat, n = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat
    return out


class _Best:
    """The best rows so far of each place: by score, then smaller id, then row."""

    def __init__(self, places: tuple[int, ...], most: int):
        self.score = np.full((*places, most), LEAST)
        self.vec_id, self.row = np.zeros_like(self.score), np.zeros_like(self.score)
        self.most = most

    def merge(self, at: tuple, scores: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        """scores (anchors, rows) with LEAST for what doesn't count; rows in order of ids. scores are used up."""
        lines, got = np.arange(len(scores)), []
        for _ in range(min(self.most, scores.shape[1])):
            top = scores.argmax(axis=1)  # the first of equal scores
            value = scores[lines, top]
            last = self.score[at][:, -1]
            if not ((value > last) | (value == last) & (value > LEAST)).any():
                break
            got.append((value.copy(), vec_id[top], row[top]))
            scores[lines, top] = LEAST
        if not got:
            return
        s, i, r = (np.concatenate([old[at], np.stack(new, axis=1)], axis=1) for old, new in zip((self.score, self.vec_id, self.row), zip(*got)))
        order = np.lexsort((r, i, -np.maximum(s, LEAST + 1)), axis=1)[:, : self.most]
        self.score[at], self.vec_id[at], self.row[at] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))


def _streamed(batches: Iterator[pa.RecordBatch], anchors: Residues, dims: int, judge) -> None:
    """judge(anchor slice, scores, batch columns) for every tile of anchors and rows (row, vec_id, label, v), rows in order of ids."""
    n = len(anchors.parts[0])
    for b in batches:
        row, vec_id, label = (b.column(k).to_numpy() for k in range(3))
        order = np.lexsort((row, vec_id))
        row, vec_id, label, v = row[order], vec_id[order], label[order], _matrix(b, dims)[order]
        for lo in range(0, len(row), TILE[1]):
            part = slice(lo, lo + TILE[1])
            theirs = Residues(v[part], anchors.primes)
            for a in range(0, n, TILE[0]):
                mine = slice(a, min(a + TILE[0], n))
                judge(mine, anchors.scores(theirs, mine), row[part], vec_id[part], label[part])


def _rows_of(best: _Best, **names: np.ndarray) -> pa.RecordBatch:
    hit = np.nonzero(best.score > LEAST)
    return pa.RecordBatch.from_pydict({**{k: v[hit[: v.ndim]] for k, v in names.items()}, "score": best.score[hit], "vec_id": best.vec_id[hit], "row": best.row[hit]})


def _numbered(table: DataFrame, anchor: Column) -> DataFrame:
    """The anchors of the written table with their number from 0, by row; one count for each partition comes to the driver."""
    some = table.where(anchor).withColumn("p", F.shiftright("row", 33))
    base, at = [], 0
    for p, n in sorted(some.groupBy("p").count().collect()):
        base.append((p, at))
        at += n
    if not base:
        return some.drop("p").withColumn("number", F.lit(0).cast("long"))
    offsets = table.sparkSession.createDataFrame(base, "p long, base long")
    place = F.row_number().over(Window.partitionBy("p").orderBy("row")) - 1
    return some.withColumn("place", place).join(F.broadcast(offsets), "p").select("row", "vec_id", "label", "v", (F.col("base") + F.col("place")).alias("number"))


def _merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _of_block(table: DataFrame, block: pa.Table, dims: int, primes: list[int], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Negatives of one block of anchors (row, vec_id, label, v), a bounded table."""
    sc = table.sparkSession.sparkContext
    numbers = {k: block.column(k).to_numpy() for k in ("row", "vec_id", "label")}
    whole = block.combine_chunks().to_batches()
    given = sc.broadcast({**numbers, "v": _matrix(whole[0], dims) if whole else np.zeros((0, dims), np.int64)})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = given.value
        best = _Best((len(a["row"]),), positives)

        def judge(mine: slice, scores: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray) -> None:
            counts = (a["label"][mine, None] == label) & (a["row"][mine, None] != row)
            best.merge((mine,), np.where(counts, scores, LEAST), vec_id, row)

        _streamed(batches, Residues(a["v"], primes), dims, judge)
        yield _rows_of(best, anchor=a["row"])

    narrow = table.select("row", "vec_id", "label", "v")
    near = _merged(narrow.mapInArrow(nearest, "anchor long, score long, vec_id long, row long"), ["anchor"], positives).toArrow()
    place = np.searchsorted(numbers["row"], near.column("anchor").to_numpy())
    rank = near.column("rank").to_numpy() - 1
    windows = np.full((2, block.num_rows, positives), 0, np.int64)
    windows[0], windows[1] = 1, 0  # empty
    score, chosen = near.column("score").to_numpy(), np.zeros((2, block.num_rows, positives), np.int64)
    windows[:, place, rank] = -(-low * score // 100), high * score // 100
    chosen[:, place, rank] = near.column("vec_id").to_numpy(), score
    limits = sc.broadcast((windows, chosen))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ((lo, hi), (positive, score)) = given.value, limits.value
        best = _Best(lo.shape, negatives)

        def judge(mine: slice, scores: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray) -> None:
            other = np.where(a["label"][mine, None] != label, scores, LEAST)
            for k in range(positives):
                counts = (other >= lo[mine, k, None]) & (other <= hi[mine, k, None])
                if counts.any():
                    best.merge((mine, k), np.where(counts, other, LEAST), vec_id, row)

        _streamed(batches, Residues(a["v"], primes), dims, judge)
        wide = np.broadcast_to(a["vec_id"][:, None], lo.shape)
        yield _rows_of(best, anchor=np.broadcast_to(a["row"][:, None], lo.shape), place=np.broadcast_to(np.arange(positives), lo.shape), anchor_id=wide, positive_id=positive, positive_score=score)

    found = narrow.mapInArrow(inside, "anchor long, place long, anchor_id long, positive_id long, positive_score long, score long, vec_id long, row long")
    return _merged(found, ["anchor", "place"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    rows: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    anchor is a condition on vec_id and label. Components become floor(scale * x); a score is the
    integer inner product. An anchor's positives are its first ``positives`` other rows of its label,
    higher scores first, ties by smaller id. The negatives of a positive are the first ``negatives``
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part.
    Rows that agree in id, label and vector are one row; different rows that share an id are rows of
    their own, each an anchor if the condition holds. Shorter vectors count as if they ended in zeros.
    A label without another row has no positives, a window without rows no negatives: no rows then. An
    empty table gives none. Other columns are not looked at. Scores must stay under 2 ** 55, else
    ValueError. The driver holds one block of anchors (``block_bytes`` of vectors) and its positives.
    """
    spark: SparkSession = rows.sparkSession
    table = written(vectors(rows, scale, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest, dims = table.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)")), F.max(F.size("v"))).first()
    if (longest or 0) >= WIDEST:
        raise ValueError("scores of these vectors don't fit; lower the scale")
    dims = max(1, dims or 0)
    primes = moduli(dims, int(longest or 0) + 1)
    anchors = written(_numbered(table, F.expr(anchor) if isinstance(anchor, str) else anchor), "anchors")
    per_block = max(1, block_bytes // (8 * dims))
    blocks = max(1, -(-anchors.count() // per_block))
    path, found = f"{shared_dir(spark).rstrip('/')}/quire-tables/negatives-{uuid.uuid4().hex}", None
    for k in range(blocks):
        block = anchors.where(F.col("number").between(k * per_block, (k + 1) * per_block - 1)).select("row", "vec_id", "label", "v").toArrow().sort_by("row")
        found = _of_block(table, block, dims, primes, positives, negatives, low, high)
        if blocks > 1:
            found.write.parquet(f"{path}/{k}")
    return found if blocks == 1 else spark.read.schema(found.schema).parquet(*[f"{path}/{k}" for k in range(blocks)])
