"""Resampling, prefix hashes and hard negatives against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from quire.llm import hard_negatives, prefix_hashes, queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    w = WORD.findall(lowered(text))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def sampled(rows, target, percent, seed, least, longest, buckets):
    """The sample by whole texts, without lines."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)[0]))
    for text in target:
        t.update(map(bucket, features(text, longest)[0]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f, n = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able) if k < percent * len(able) // 100}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_is_the_loop(spark, docs, longest):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    target = spark.createDataFrame([(x,) for x in bench], "text string")
    got = resampling.resample(docs, target, percent=30, longest=longest, buckets=997)
    assert sorted(map(tuple, got.collect()), key=repr) == sampled(rows, bench, 30, 2024, 20, longest, 997)


def test_resample_of_edge_rows(spark, edge, empty, edge_rows):
    rows = [*edge_rows, (20, "One\r\ntwo\n\n\nTWO three\x00four\né ÉA b"), (21, "\n".join(["same line of words"] * 40)), (22, "é" * 30)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(edge.select("doc_id", "text").unionByName(one.where("doc_id >= 20")), one, percent=60, least_words=3, longest=2)
    assert sorted(map(tuple, got.collect()), key=repr) == sampled(rows, [t for _, t in rows], 60, 2024, 3, 2, 10_000)
    assert {tuple(r)[1:3] for r in resampling.resample(edge, empty).where("doc_id IN (1, 2, 8)").collect()} == {(0, 0)}
    assert resampling.resample(empty, edge).count() == 0


def test_lines_count_once_and_crossing_runs_are_added(spark):
    text = "a b\nc\n\nd e f\ng"
    assert sorted(resampling.crossing([resampling.words(x) for x in text.split("\n")], 3)) == sorted([b"b c", b"c d", b"f g", b"a b c", b"b c d", b"c d e", b"e f g"])
    table = spark.createDataFrame([(text,), (text,), ("A B",), (None,)], "text string")
    assert {r.line: r.n for r in resampling.line_counts(table).collect()} == {"a b": 3, "c": 2, "d e f": 2, "g": 2}


def test_spans_and_extensions_are_those_of_the_texts():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        b = rng.choice([a, a[rng.randrange(len(a)) :], "".join(rng.choice("ab") for _ in range(40))]) + "b"
        x, y = prefix_hashes.PrefixHashes(a), prefix_hashes.PrefixHashes(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    assert prefix_hashes.fingerprint("\x00") != prefix_hashes.fingerprint("\x00\x00")


def test_fingerprint_is_the_loop_in_any_blocks(monkeypatch):
    rng, p, base = random.Random(3), prefix_hashes.P, prefix_hashes.BASES[0]
    texts = ["", "a", "abcdefgh", "x" * 500, "aé\U0001f600b" * 9, "".join(rng.choice("abcdefgh ") for _ in range(3000))]

    def plain(text):
        sums = [0]
        for i, c in enumerate(text):
            sums.append((sums[-1] + (ord(c) + 1) * pow(base, i, p)) % p)
        seen = {}
        for i in range(len(text) - 7):
            v = (sums[i + 8] - sums[i]) * pow(base, -i, p) % p
            seen.setdefault(v, i)
        mixed = lambda v: v * 0x9E3779B97F4A7C15 % 2**64 >> 33
        best = sorted(seen, key=lambda v: (mixed(v), seen[v]))[: prefix_hashes.PLACES]
        return len(text), sums[-1], sorted((seen[v], v, sums[seen[v]]) for v in best)

    for block in (1 << 18, 64):
        monkeypatch.setattr(prefix_hashes, "BLOCK", block)
        for t in texts:
            f = prefix_hashes.fingerprint(t)
            n, s, _ = np.frombuffer(f, prefix_hashes.HEAD, 1)[0].tolist()
            assert (n, s, np.frombuffer(f, prefix_hashes.ENTRY, -1, 16).tolist()) == plain(t)


def test_likeness_follows_what_is_common(docs):
    texts = [r.text for r in docs.where("length(text) > 600").orderBy("doc_id").limit(40).collect()]
    prints = [prefix_hashes.fingerprint(t) for t in texts]
    near, far = [], []
    for k, t in enumerate(texts):
        other = texts[k - 1]
        new = prefix_hashes.edited(t, other)
        common = max(len(t) - len(t) // 3, sum(m.size for m in SequenceMatcher(None, t, new, autojunk=False).get_matching_blocks() if m.size >= 8)) if len(t) < 1500 else None
        like = prefix_hashes.likeness(prints[k], prefix_hashes.fingerprint(new))
        if common:
            assert like <= common / len(t) + 0.02
        near.append(like)
        far.append(prefix_hashes.likeness(prints[k], prints[k - 1]))
        shifted = prefix_hashes.likeness(prints[k], prefix_hashes.fingerprint("One more sentence. " + t))
        assert shifted > 0.7  # an insertion only moves the places
        assert prefix_hashes.likeness(prints[k], prints[k]) == 1
    assert np.mean(near) > 0.58 and np.quantile(near, 0.1) > 0.5 and np.median(far) < 0.1
    assert prefix_hashes.likeness(prefix_hashes.fingerprint(""), prints[0]) == 0


def test_edited_texts_take_the_next_of_descending_ids(spark, edge, empty, edge_rows):
    got = prefix_hashes.compared(edge.repartition(5)).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in edge_rows}], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    rows = sorted(edge_rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(text) // 3
        new = text[: len(text) - m] + after[:m]
        own, other = prefix_hashes.fingerprint(text), prefix_hashes.fingerprint(new)
        want.append((i, len(text), hashlib.sha256(new.encode()).digest(), own, other, prefix_hashes.likeness(own, other), prefix_hashes.likeness(own, prefix_hashes.fingerprint(after))))
    plain = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3]), bytes(r[4]), *r[5:]) for r in got), key=repr)
    assert plain == sorted(want, key=repr)
    assert prefix_hashes.compared(empty).count() == 0
    one = prefix_hashes.compared(edge.where("doc_id = 6")).first()
    assert one.near_next == 1 and one.near_edited < 1
    assert {r.doc_id: bytes(r.fingerprint) for r in prefix_hashes.fingerprints(edge).collect()} == {r[0]: r[3] for r in want}


def test_residue_products_are_exact():
    rng = np.random.default_rng(7)
    for dims, top in ((1, 10), (64, 150), (64, 1 << 20), (700, 4000), (9000, 300)):
        a, b = rng.integers(-top, top + 1, (7, dims)), rng.integers(-top, top + 1, (5, dims))
        a[0], b[0] = top, -top
        primes = hard_negatives.moduli(dims, dims * top * top)
        assert len(set(primes)) == len(primes) and math.prod(primes) > 4 * dims * top * top
        got = hard_negatives.Residues(a, primes).scores(hard_negatives.Residues(b, primes))
        assert (got == a @ b.T).all()


def mined(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Hard negatives by a loop over all rows."""
    held = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i, y, tuple(math.floor(scale * x) for x in v)] = 1
    out = []
    for a in (r for r in held if is_anchor(r[0])):
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2])), r) for r in held if r != a), key=lambda x: (-x[0], x[1][0]))
        for s, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            fits = [x for x in scored if x[1][1] != a[1] and low * s <= 100 * x[0] <= high * s][:negatives]
            out += [(a[0], p[0], k + 1, n[0], s, t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_are_the_loop(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.3, 1.0, 2.0]) for _ in range(rng.choice([4, 4, 3]))], rng.randrange(3)) for i in range(150)]
    rows += [(None, [1.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [float("nan")], 1), (40, [float("-inf")], 2), (50, [1.0, 2.0], None), (60, [], 1), rows[0], rows[7], rows[7], (200, [9.0, 9.0, 9.0, 9.0], 77)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS score", "2 AS row", "'x' AS v", "3 AS number", "4 AS anchor").repartition(4)
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 50
    for size in (1 << 20, 5 * 8 * 4):  # all anchors at once, and blocks of five
        assert sorted(map(tuple, hard_negatives.hard_negatives(table, "vec_id % 10 = 0", block_bytes=size).collect())) == want
    assert hard_negatives.hard_negatives(table.limit(0), "vec_id % 10 = 0").count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e18], 1)], table.select("vec_id", "embedding", "label").schema), "true")


def test_queries_keep_the_shape_of_their_contracts(spark, sf, docs):
    n = docs.count()
    found = queries.op12_prefix_hashes(spark, sf)
    assert found.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and found.count() == n
    r = {x.doc_id: x for x in found.collect()}
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        assert r[i].edited_sha256 == hashlib.sha256(prefix_hashes.edited(texts[i], texts[ids[(k + 1) % n]]).encode()).hexdigest() and r[i].n_chars == len(texts[i])
    drawn = queries.op11_resampling(spark, sf).where("rank IS NOT NULL")
    able = sum(len(WORD.findall(lowered(t))) >= 20 for t in texts.values())
    assert sorted(x["rank"] for x in drawn.collect()) == list(range(1, able // 10 + 1))
