"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0], c[1], ... give the modular prefix sums S[i] = c[0] + c[1] B + ... + c[i-1] B^(i-1).
Two of them answer whether any two spans are equal, so that the longest common extension of two
places is found by binary search. A fingerprint is a sparse prefix array: the sums at places that
the text itself chooses (the windows with the smallest hashes), with the window's hash, and the sums of the
whole. Between two fingerprints, places with the same window are matched, binary search finds how
far the spans from there on agree, and the share of code points covered is the likeness.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import written
from quire.llm.substring import byte_slices

P = (1 << 31) - 1
# The bases of the two sums.
BASES = (1_203_483_731, 776_531_401)
WINDOW = 8  # code points of a window that chooses a place
PLACES = 24  # places that a fingerprint keeps at most
BLOCK = 1 << 18  # code points whose sums are held at once for a fingerprint
HEAD, ENTRY = np.dtype([("n", "<u8"), ("s", "<u4"), ("z", "<u4")]), np.dtype([("at", "<u4"), ("window", "<u4"), ("s", "<u4")])
_UP: list[np.ndarray] = [np.ones(1, np.uint64)] * 4  # powers of the two bases, then of their inverses


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x under 2 ** 63."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


def _powers(kind: int, n: int) -> np.ndarray:
    """The first n powers of a base (0, 1) or of its inverse (2, 3)."""
    base = BASES[kind % 2] if kind < 2 else pow(BASES[kind % 2], -1, P)
    while len(_UP[kind]) < n:
        up = _UP[kind]
        _UP[kind] = np.concatenate([up, _mod(up * np.uint64(pow(base, len(up), P)))])
    return _UP[kind][:n]


def codes(text: str | None) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(c: np.ndarray, kind: int, first: int = 0) -> np.ndarray:
    """Prefix sums of c modulo P, from ``first`` on: one more than c has code points."""
    out = np.empty(len(c) + 1, np.uint64)
    out[0] = first
    np.cumsum(_mod((c.astype(np.uint64) + np.uint64(1)) * _powers(kind, len(c))), out=out[1:])  # 1 is added so that no code point counts as nothing
    out[1:] += np.uint64(first)
    return _mod(out)


class PrefixHashes:
    """The prefix arrays of a whole text under both bases."""

    def __init__(self, text: str | None):
        self.codes = codes(text)
        self.sums = [_sums(self.codes, k) for k in (0, 1)]

    def span(self, at: int, length: int) -> tuple[int, int]:
        """The hash of a span, the same wherever the span lies."""
        return tuple((int(s[at + length]) - int(s[at])) * int(_powers(2 + k, at + 1)[at]) % P for k, s in enumerate(self.sums))

    def equal(self, at: int, other: PrefixHashes, there: int, length: int) -> bool:
        """Whether the spans of ``length`` code points at both places agree."""
        return self.span(at, length) == other.span(there, length)

    def extension(self, at: int, other: PrefixHashes, there: int) -> int:
        """Length of the longest common extension of both places, by binary search."""
        most = min(len(self.codes) - at, len(other.codes) - there)
        return bisect_right(range(1, most + 1), False, key=lambda n: not self.equal(at, other, there, n))


def fingerprint(text: str | None) -> bytes:
    """Sparse prefix array of a text: its length, both sums of the whole, then (place, window hash, sum before it) by place.

    Of the distinct windows those whose mixed hashes are smallest are kept, each at its first
    place, so that places depend on what stands there and not on where it stands. Texts shorter than a window have no
    places, empty and null texts the same fingerprint. The sums are held for a block at a time.
    """
    c = codes(text)
    n = len(c)
    total, share = max(1, n - WINDOW + 1), 1
    while True:
        limit = min(P, P * PLACES * 4 * share // total)
        first, kept = [0, 0], []
        for lo in range(0, n, BLOCK):
            part = c[lo : lo + BLOCK + WINDOW - 1]
            s, size = _sums(part, 0), min(BLOCK, n - lo)
            up = pow(BASES[0], lo, P)
            if len(part) >= WINDOW:
                v = _mod((s[WINDOW:] + np.uint64(P) - s[:-WINDOW]) * _powers(2, len(part) - WINDOW + 1))
                mixed = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                at = np.flatnonzero(mixed <= limit)
                kept.append(np.stack([mixed[at], at.astype(np.uint64) + np.uint64(lo), v[at], _mod(np.uint64(first[0]) + _mod(s[at] * np.uint64(up)))]))
            if share == 1:
                last = _sums(part[:size], 1)[-1]
                first[1] = (first[1] + int(last) * pow(BASES[1], lo, P)) % P
            first[0] = (first[0] + int(s[size]) * up) % P
        whole = whole if share > 1 else first
        found = np.concatenate(kept, axis=1) if kept else np.zeros((4, 0), np.uint64)
        found = found[:, np.lexsort((found[1], found[0]))]
        found = found[:, np.r_[True, found[0, 1:] != found[0, :-1]]] if found.shape[1] else found
        if found.shape[1] >= PLACES or limit >= P:
            break
        share *= 8
    found = found[:, :PLACES]
    found = found[:, np.argsort(found[1])]
    out, head = np.zeros(found.shape[1], ENTRY), np.zeros(1, HEAD)
    out["at"], out["window"], out["s"] = found[1], found[2], found[3]
    head["n"], head["s"], head["z"] = n, *whole
    return head.tobytes() + out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of the longer text's code points that lie in spans found equal, from 0 to 1; 1 for equal fingerprints.

    Matched places are the beginnings, the ends and equal windows. From each, binary search looks for the
    furthest further one at the same distance up to which the sums agree.
    """
    if a == b:
        return 1.0
    (na, sa, _), (nb, sb, _) = (np.frombuffer(x, HEAD, 1)[0].tolist() for x in (a, b))
    if not na or not nb:
        return 0.0
    mine, theirs = (np.frombuffer(x, ENTRY, -1, HEAD.itemsize).tolist() for x in (a, b))
    there = {v: (at, s) for at, v, s in theirs}
    pairs = [(0, 0, 0, 0, 0), *((at, s, *there[v], WINDOW) for at, v, s in mine if v in there), (na, sa, nb, sb, 0)]
    base, k, covered, end = BASES[0], 0, 0, 0
    while k < len(pairs):
        at, s, to, t, own = pairs[k]
        same = k + 1
        while same < len(pairs) and pairs[same][0] - at == pairs[same][2] - to:
            same += 1
        shift = pow(base, abs(at - to), P)  # both spans as they would stand at the later of the places
        up, down = (1, shift) if at >= to else (shift, 1)
        unequal = lambda q: ((pairs[q][1] - s) * up - (pairs[q][3] - t) * down) % P != 0  # noqa: B023,E731
        far = k + bisect_right(range(k + 1, same), False, key=unequal)
        stop = min(pairs[far][0] + pairs[far][4], na)
        covered += max(0, stop - max(at, end))
        end = max(end, stop)
        k = far + 1
    return min(1.0, covered / max(na, nb))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint binary), a row for each row of docs; see :func:`fingerprint`. An empty table gives none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array([fingerprint(t) for t in texts], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_chars long, fingerprint binary").withColumnRenamed("doc_id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_DIGEST = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _digest(doc_id: int | None, text: str, own: bytes, following: str, after: bytes) -> tuple:
    new = edited(text, following)
    changed = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), own, changed, likeness(own, changed), likeness(own, after)


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row against the next in descending order of ids.

    The next of the last row is the first one. Rows with equal ids follow each other by their text's
    xxhash64, repeated rows each count, and null ids come last. A null text is empty. A
    table of one row is its own next; an empty one gives no rows. Other columns are not looked at.

    Rows are range sorted, and a task holds two texts besides its batch. Only the first and the last row
    of each partition are kept with their texts and meet in a second step; the driver knows the numbers of the partitions.
    """
    order = [F.desc_nulls_last("doc_id"), "hashed"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hashed"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in _DIGEST.split(", ")]

    def table(found: list[tuple], **more: pa.Array) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(names)
        return pa.RecordBatch.from_pydict({**{k: pa.array(x, t) for k, x, t in zip(names, columns, types)}, **more})

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            blank = (row[0], len(row[1]), None, row[2], None, None, None)
            return table([blank], part=pa.array([part], pa.int32()), edge=pa.array([kind], pa.int32()), text=pa.array([row[1]], pa.string()))

        for b in byte_slices(batches, 1):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                row = (doc_id, text, last[2] if last and last[1] == text else fingerprint(text))
                if last is None:
                    part = b.column(2)[0].as_py()
                    yield edge(1, row)
                else:
                    out.append(_digest(*last, row[1], row[2]))
                last = row
            none = pa.nulls(len(out), pa.int32())
            yield table(out, part=none, edge=pa.array([0] * len(out), pa.int32()), text=pa.nulls(len(out), pa.string()))
        if last is not None:
            yield edge(2, last)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            yield table([_digest(*(b.column(k)[i].as_py() for k in range(5))) for i in range(b.num_rows)])

    held = written(rows.mapInArrow(inner, f"{_DIGEST}, part int, edge int, text string"), "neighbours")
    parts = sorted(r["part"] for r in held.where("edge = 1").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follows int")
    heads = held.where("edge = 1").select(F.col("part").alias("follows"), F.col("text").alias("after"), F.col("fingerprint").alias("its"))
    tails = held.where("edge = 2").select("doc_id", "text", "fingerprint", "part").join(F.broadcast(follows), "part")
    met = tails.join(heads, "follows").select("doc_id", "text", "fingerprint", "after", "its").mapInArrow(outer, _DIGEST)
    return held.where("edge = 0").select(*names).unionByName(met).withColumnRenamed("doc_id", id_col)
