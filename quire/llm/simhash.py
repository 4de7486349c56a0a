"""SimHash near-duplicates: fingerprints compared exactly in tiles.

Narrow fingerprints (64 bits) are cut into ``radius + 1`` blocks; two within the radius agree on
one whole block at least, so only fingerprints that share a block meet. A block value that too many
fingerprints have is cut further: what is left of them is again dealt by ``radius + 1`` blocks, and
so on, so that every pair still meets, rows grow by a constant factor and no task holds more than
``tile_rows`` of them. Inside a group the rows lie in order of their population counts and are
compared tile against tile with numpy exclusive-or and bit counts; a tile pair is skipped if its
population counts differ by more than the radius, or if all its rows are linked already.

Near copies (Jaccard similarity of five-word shingles) meet under bands of minimum hashes, are
compared in the same tiles by wide fingerprints, and what is near there is verified by its sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.tables import small_batches
from quire.llm.components import components
from quire.llm.store import cut, written
from quire.llm.substring import build_filter, byte_slices

SMALL = 24  # groups up to this size are compared by shifting, all groups of a batch at once
TILE = 512
WIDE = 4  # words of a wide fingerprint
HALF = 52  # bits in which the first two of four words may differ; 24 are expected at most at a similarity of 0.8, with a deviation of 4.4
RADIUS = 72  # bits of a wide fingerprint; of 400 pairs each at a similarity of 0.8 the furthest were 65 (4 shingles against 5) and 51 apart
BANDS, ROWS = 20, 4  # minimum hashes
CHUNK = 1 << 21  # shingles of a cluster that are compared at once
MASK = (1 << 64) - 1


def text_fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < ngram:
        values = [hashed(join(words), seed)]
    else:
        values = [hashed(join(x), seed) for x in zip(*(words[i:] for i in range(ngram)))]
    ones, h = np.zeros(64, np.int64), np.array(values, "<u8")
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def shingles(text: str | None, ngram: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the words of short texts are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    some = zip(*(words[i:] for i in range(ngram))) if len(words) >= ngram else [words]
    return np.unique(np.fromiter((hashed(join(x), 42) for x in some), np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """256-bit SimHash of distinct shingle hashes as four words."""
    out = np.zeros(WIDE, np.uint64)
    for k in range(WIDE if len(h) else 0):
        x = h * np.uint64(2 * k + 1)  # another mix of the bits for each word
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 14):
            ones += np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


_SALTS = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """BANDS keys of distinct shingle hashes, each of ROWS minimum hashes: sets of a similarity j share a given key with a chance of j ** ROWS."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 10):
        np.minimum(low, ((h[at : at + (1 << 10), None] ^ _SALTS[0]) * _SALTS[1]).min(axis=0), out=low)
    key = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def fingerprint(text: Column, ngram: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a signed long (the unsigned bits)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, ngram, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of links a-b in label (each entry points at its smallest known member)."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints (last axis: words) differ in at most radius bits; later words only where the first two differ in HALF at most."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    if a.shape[-1] > 1:
        d += np.bitwise_count(a[..., 1] ^ b[..., 1])
    near = d <= (min(radius, HALF) if a.shape[-1] > 2 else radius)
    if a.shape[-1] > 2 and near.any():
        at = np.nonzero(near)
        x, y = np.broadcast_arrays(a, b)
        near[at] = np.bitwise_count(x[at] ^ y[at]).sum(axis=-1, dtype=np.uint16) <= radius
    return near


def _forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, root) of all pairs within the radius; rows sorted by group, then population count."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    label, count = np.arange(n), np.bitwise_count(fp).sum(axis=1, dtype=np.int16)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the group from this one on
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL)
    for d in range(1, SMALL):
        small = small[left[small] > d]
        if not len(small):
            break
        hit = small[_near(fp[small], fp[small + d], radius)]
        label = _settle(label, hit, hit + d)
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        own, x, ones = np.arange(size), fp[s : s + size], count[s : s + size]
        for i in range(0, size, TILE):
            ie = min(i + TILE, size)
            for j in range(i, size, TILE):
                if ones[j] - ones[ie - 1] > radius:  # sorted: all later tiles are further off
                    break
                je = min(j + TILE, size)
                if (own[i:ie] == own[i]).all() and (own[j:je] == own[i]).all():  # one component already
                    continue
                a, b = np.nonzero(_near(x[i:ie, None], x[None, j:je], radius))
                own = _settle(own, a + i, b + j)
        label[s : s + size] = own + s
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _tiles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, c, node, words ...) -> forest links (a, b); a group (k, c) that spans batches is held until it ends."""
    held = None

    def out(x: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(group, np.ascontiguousarray(x[3:].T).view(np.uint64), radius)
        return pa.RecordBatch.from_pydict({"a": x[2, a], "b": x[2, b]})

    def grouped(x: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[0, (x[:2, 1:] != x[:2, :-1]).any(axis=0)])

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        x = x if held is None else np.concatenate([held, x], axis=1)
        group = grouped(x)
        last = int(np.searchsorted(group, group[-1]))
        held = x[:, last:]
        if last:
            yield out(x[:, :last], group[:last])
    if held is not None:
        yield out(held, grouped(held))


def _compared(dealt: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Rows (k, c, node, words) -> links (a, b) of nodes that span the pairs within the radius in each group (k, c)."""
    ones = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    rows = dealt.select("k", "c", "node", *words, ones.alias("ones")).repartition("k", "c").sortWithinPartitions("k", "c", "ones", "node")
    return rows.select("k", "c", "node", *words).mapInArrow(lambda it: _tiles(it, radius), "a long, b long")


def _cut_out(value: Column, at: Column, edges: list[int]) -> Column:
    """value without the bits of block ``at``; what lies above moves down."""
    out = F.lit(0).cast("long")
    for t, (lo, hi) in enumerate(zip(edges, edges[1:])):
        above = F.shiftleft(F.shiftrightunsigned(value, hi), lo) if hi < 64 else F.lit(0).cast("long")
        out = F.when(at == t, above.bitwiseOR(value.bitwiseAND((1 << lo) - 1))).otherwise(out)
    return out


def near_links(classes: DataFrame, radius: int = 3, tile_rows: int = 1 << 16) -> DataFrame:
    """(fingerprint, rep) with distinct fingerprints -> links (a, b) of reps that span every component of pairs within the radius.

    Groups of more than ``tile_rows`` fingerprints go on to further blocks of the bits in which they
    may still differ; when these have ``tile_rows`` values at most, no group can be larger. Rows with a null rep
    are left out; an empty table gives no links; columns other than the two are not looked at.
    """
    n, width, links = radius + 1, 64, []
    rows = classes.where("rep is not null").select("rep", "fingerprint", F.lit(0).cast("long").alias("k"), F.col("fingerprint").alias("rest"))
    while True:
        edges = [round(width * i / n) for i in range(n + 1)]
        parts = F.array(*[F.shiftrightunsigned("rest", lo).bitwiseAND((1 << hi - lo) - 1) for lo, hi in zip(edges, edges[1:])])
        keyed = rows.select("rep", "fingerprint", "k", "rest", F.posexplode(parts).alias("t", "v"))
        keyed = keyed.select(F.xxhash64("k", "t", "v").alias("k"), "rep", "fingerprint", _cut_out(F.col("rest"), F.col("t"), edges).alias("rest"))
        full = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("k"))
        last = full.isEmpty() or 1 << width <= tile_rows
        cold = keyed if last else keyed.join(full, "k", "left_anti")
        links.append(_compared(cold.select("k", F.lit(0).cast("long").alias("c"), F.col("rep").alias("node"), "fingerprint"), ["fingerprint"], radius))
        if last:
            return reduce(DataFrame.unionByName, links)
        rows = written(keyed.join(full, "k", "left_semi"), "further-blocks")
        width -= min(hi - lo for lo, hi in zip(edges, edges[1:]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, ngram: int = 3, tile_rows: int = 1 << 16) -> DataFrame:
    """One row per document: (id, fingerprint, component_id), component_id the smallest id within reach.

    A null or wordless text has fingerprint 0 and links like any other. A row with a null id takes
    the component of its fingerprint (null if only such rows have it). Repeated rows each get a row;
    an empty table gives none; other columns are not looked at. Links are complete: rows with one
    fingerprint are one class, and classes are linked exactly.
    """
    fps = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), ngram).alias("fingerprint")))
    classes = cut(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(classes, radius, tile_rows))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fingerprint").select(F.col("doc_id").alias(id_col), "fingerprint", "component_id")


def _similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span all pairs of sets with a Jaccard similarity of 0.8 or more; sets in order of size."""
    size, label = np.array([len(x) for x in sets]), np.arange(len(sets))
    ends, flat = np.cumsum(size), np.concatenate(sets)
    known, flat, times = np.unique(flat, return_inverse=True, return_counts=True)
    top = np.searchsorted(size, size * 5 // 4, "right")  # larger sets can't reach 0.8
    if np.count_nonzero(times > 1) < 64 * size.mean():  # sets of one kind: a row of bits for each, over what two sets have at least
        place = np.cumsum(times > 1) - 1
        row, keep = np.repeat(np.arange(len(sets)), size), times[flat] > 1
        bits = np.zeros((len(sets), -(-int(place[-1] + 1) // 64) * 64 or 64), bool)
        bits[row[keep], place[flat[keep]]] = True
        bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        tile = max(8, min(TILE, (1 << 20) // bits.shape[1]))
        for i in range(len(sets)):
            for j in range(i + 1, int(top[i]), tile):
                je = min(j + tile, int(top[i]))
                if (label[j:je] == label[i]).all():
                    continue
                both = np.bitwise_count(bits[i] & bits[j:je]).sum(axis=1, dtype=np.int64)
                hit = j + np.flatnonzero(9 * both >= 4 * (size[i] + size[j:je]))
                label = _settle(label, np.full(len(hit), i), hit)
    else:
        mark = np.zeros(len(known), np.int32)
        for i in range(len(sets)):
            other = i + 1 + np.flatnonzero(label[i + 1 : top[i]] != label[i])
            if not len(other):
                continue
            own = flat[ends[i] - size[i] : ends[i]]
            mark[own] = 1
            inside = mark[np.concatenate([flat[ends[j] - size[j] : ends[j]] for j in other])]
            both = np.add.reduceat(inside, np.r_[0, np.cumsum(size[other])[:-1]])
            mark[own] = 0
            hit = other[9 * both.astype(np.int64) >= 4 * (size[i] + size[other])]
            label = _settle(label, np.full(len(hit), i), hit)
    member = np.flatnonzero(label != np.arange(len(sets)))
    return member, label[member]


def _verified(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, c, n, node, text) -> links of nodes whose shingle sets are similar; one group is held at a time."""
    key, nodes, sets = None, [], []

    def out() -> pa.RecordBatch:
        a, b = _similar(sets)
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_pydict({"a": at[a], "b": at[b]})

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for k, node, text in zip(keys, batch.column(3).to_pylist(), batch.column(4)):
            if k != key:
                if len(sets) > 1:
                    yield out()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(shingles(text.as_py(), ngram))
    if len(sets) > 1:
        yield out()


def _dealt(keyed: DataFrame, limit: int) -> DataFrame:
    """Rows (k, node, weight, ...) -> (k, c, node, weight, ...): groups (k, c) whose weights sum up to 2 * limit at most, in the mean.

    A key whose weights exceed the limit is dealt out in g chunks, and there is a group for each two of
    them, so that every pair of its rows meets: its rows grow by g - 1, the groups stay as small and are many tasks' work.
    """
    rest = [c for c in keyed.columns if c != "k"]
    full = cut(keyed.groupBy("k").agg(F.sum("weight").alias("n")).where(F.col("n") > limit).select("k", F.ceil(F.col("n") / limit).cast("long").alias("g")))
    if full.isEmpty():
        return keyed.select("k", F.lit(0).cast("long").alias("c"), *rest)
    marked = keyed.join(full, "k", "left").withColumn("__own", F.pmod(F.xxhash64("node", "k"), "g"))
    pairs = F.expr("transform(filter(sequence(0L, g - 1), x -> x <> __own), x -> least(x, __own) * g + greatest(x, __own))")
    return marked.select("k", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("c"), *rest)


def _exact_links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, ngram: int, chunk: int) -> DataFrame:
    """(doc_id, hashed, text), (node, component) and classes -> links (a, b) that span the pairs of a component with a similarity of 0.8 or more."""
    keyed = clusters.join(classes.select("node", "doc_id", "hashed", "n"), "node").select(F.col("component").alias("k"), "node", F.col("n").alias("weight"), "doc_id", "hashed")
    wanted = _dealt(written(keyed, "clusters"), chunk)
    some = build_filter(docs.sparkSession, wanted.select(F.xxhash64("doc_id", "hashed").alias("h")).distinct(), 26)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(some.value.has(h.to_numpy().view(np.uint64)))

    # texts that surely aren't wanted are not shuffled; of repeated rows one is read
    texts = docs.where(maybe(F.xxhash64("doc_id", "hashed"))).groupBy("doc_id", "hashed").agg(F.first("text").alias("text"))
    rows = wanted.join(texts, ["doc_id", "hashed"]).select("k", "c", F.col("weight").alias("n"), "node", "text")
    rows = rows.repartition("k", "c").sortWithinPartitions("k", "c", "n", "node")
    return rows.mapInArrow(lambda it: _verified(it, ngram), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, ngram: int = 5, tile_rows: int = 1 << 16, chunk: int = CHUNK) -> DataFrame:
    """(id, hashed, component_id, first) of the distinct rows; links are the pairs whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

    Texts that share one of BANDS keys of minimum hashes are compared in tiles by 256-bit SimHashes
    over distinct shingles, which only gives candidates: at 0.8 they differ in 39 bits on average
    (48 for 4 shingles against 5, with a deviation of 6), unrelated texts in 128. Inside a cluster of
    candidates the sets themselves are compared, and only pairs of 0.8 or more are linked. A pair of
    just 0.8 shares no key with a chance of 3 in 100,000. Sets under 4 shingles have equal partners only.

    hashed is xxhash64 of the text; component_id the smallest id within reach; first marks the one
    row of each component with the smallest (id, hashed). Equal ids with different texts are
    different rows; repeated rows are one. Rows with null ids or without words keep to themselves
    (component: the id; first). An empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    words = [f"w{k}" for k in range(WIDE)]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2):
            found = [shingles(t.as_py(), ngram) for t in b.column(2)]
            wide = np.array([wide_fingerprint(h) for h in found]).view(np.int64).reshape(-1, WIDE)
            key = np.array([bands(h) if len(h) > 3 else np.zeros(BANDS, np.uint64) for h in found]).view(np.int64).reshape(-1, BANDS)
            sums = np.array([(x & MASK, x >> 64) for x in (xxhash.xxh3_128_intdigest(h.tobytes()) for h in found)], np.uint64).view(np.int64).reshape(-1, 2)
            columns = {"doc_id": b.column(0), "hashed": b.column(1), "n": pa.array([len(h) for h in found], pa.int64()), "k1": sums[:, 0], "k2": sums[:, 1], **{w: np.ascontiguousarray(wide[:, k]) for k, w in enumerate(words)}}
            yield pa.RecordBatch.from_pydict({**columns, "bands": pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), BANDS).cast(pa.list_(pa.int64()))})

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("hashed"), F.col(text_col).alias("text"))
    schema = "doc_id long, hashed long, n long, k1 long, k2 long, " + "".join(f"{w} long, " for w in words) + "bands array<long>"
    fps = written(docs.mapInArrow(signed, schema), "fingerprints")
    named = fps.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "hashed", *words, "bands")).alias("x")).select("n", "k1", "k2", "x.*")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.where("n > 3").select(F.posexplode("bands").alias("t", "v"), "node", *words).select(F.xxhash64("t", "v").alias("k"), "node", F.lit(1).alias("weight"), *words)
    near = _compared(_dealt(keyed, tile_rows), words, radius)
    clusters = components(near).withColumnRenamed("component", "k").select("node", F.col("k").alias("component"))
    found = components(_exact_links(docs, cut(clusters), classes, ngram, chunk))
    least = classes.join(found, "node", "left").select("n", "k1", "k2", "doc_id", "hashed", F.coalesce("component", "node").alias("component"))
    least = least.join(least.groupBy("component").agg(F.min(F.struct("doc_id", "hashed")).alias("least")), "component").select("n", "k1", "k2", "least")
    joined = named.select("doc_id", "hashed", "n", "k1", "k2").distinct().join(least, ["n", "k1", "k2"])
    linked = joined.select("doc_id", "hashed", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "hashed") == F.col("least")).alias("first"))
    alone = fps.where("n = 0 OR doc_id IS NULL").select("doc_id", "hashed", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")).distinct()
    return linked.unionByName(alone).withColumnRenamed("doc_id", id_col)
