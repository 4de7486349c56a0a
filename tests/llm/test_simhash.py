import random

import numpy as np
import pandas as pd
import xxhash

from quire.llm import simhash


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    n = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles)) if shingles else 0


def plain_components(ids, fps, radius=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= radius:
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_equal_plain_python(docs):
    got = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()}
    for r in docs.limit(40).collect():
        assert got[r.doc_id] == plain_fingerprint(r.text)


def test_links_equal_all_pairs(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(60)} | {0}
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "rep long, fingerprint long")
    want = plain_components(list(range(len(fps))), fps)
    for tile in (1 << 16, 100, 16):
        links = simhash.near_links(classes, 3, tile)
        got = {r.node: r.component for r in simhash.components(links).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert links.count() < len(fps) * 40  # forests, not all pairs


def test_blocks_of_full_keys_are_cut_on(spark):
    """All fingerprints share three of four blocks: these keys are full, and go on to blocks of the rest."""
    rnd = random.Random(5)
    fps = sorted({0x1234_5678_0000_9ABC ^ rnd.getrandbits(16) << 16 for _ in range(3000)})
    classes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "rep long, fingerprint long")
    got = {r.node: r.component for r in simhash.components(simhash.near_links(classes, 3, 200)).collect()}
    want = plain_components(list(range(len(fps))), fps)
    assert {i: got.get(i, i) for i in want} == want
    lone = spark.createDataFrame([(i, (i * 0x0101_0101) << 8 | 0xFF) for i in range(0, 250, 17)], "rep long, fingerprint long")
    values = [r.fingerprint for r in lone.collect()]
    got = {r.node: r.component for r in simhash.components(simhash.near_links(lone, 3, 4)).collect()}
    want = plain_components([i for i in range(0, 250, 17)], values)
    assert {i: got.get(i, i) for i in want} == want


def test_edges(edge, empty):
    rows = {(r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(edge).collect()}
    by = {i: c for i, c, _ in rows}
    assert by[1] == by[2] == by[8] == 1 and by[5] == 4 and by[3] == 3 and by[11] == 6 and by[None] is None
    assert simhash.near_duplicates(edge).count() == edge.count() and simhash.near_duplicates(empty).count() == 0


def test_wide_fingerprints_find_similar_texts(spark):
    rnd, rows, pairs = random.Random(3), [], []
    vocabulary = [f"w{i}" for i in range(3000)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 200, 600]))]
        rows.append((i, w))
        for c in range(2):
            v = list(w)
            for _ in range(rnd.randrange(0, 1 + len(w) // 40)):
                v[rnd.randrange(len(v))] = rnd.choice(vocabulary)
            rows.append((1000 + 2 * i + c, v))
            pairs.append((i, 1000 + 2 * i + c, len(shingles(w) & shingles(v)) / len(shingles(w) | shingles(v))))
    d = spark.createDataFrame(pd.DataFrame([(i, " ".join(w)) for i, w in rows], columns=["doc_id", "text"]))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(d).collect()}
    assert all(got[i] == i for i in range(60))
    near = [got[i] == got[k] for i, k, j in pairs if j >= 0.85]
    assert sum(near) >= 0.95 * len(near)


def test_near_copies_edges(edge, empty):
    got = [(r.doc_id, r.component_id) for r in simhash.near_copies(edge).collect()]
    by = dict(got)
    assert len(got) == edge.count() - 1  # of the repeated row one
    assert by[1] == 1 and by[2] == 2 and by[5] == 4 and by[11] == 6 and by[None] is None
    assert simhash.near_copies(empty).count() == 0


def test_near_copies_equal_brute_force_around_the_threshold(spark):
    rnd, rows, pairs = random.Random(8), [], []
    for n, extra in [(4, 1), (6, 1), (5, 2), (50, 12), (50, 13), (50, 20), (90, 16), (90, 30), (200, 50), (200, 51), (200, 85)] * 40:  # the longer text has extra shingles
        w = [f"w{rnd.randrange(10**6)}" for _ in range(n + extra + 4)]
        i = len(rows)
        rows += [(i, " ".join(w[: n + 4])), (i + 1, " ".join(w))]
        pairs.append((i, 5 * n >= 4 * (n + extra)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(d).collect()}
    assert [(got[i + 1] == i) for i, _ in pairs] == [near for _, near in pairs]
    assert len(got) == len(rows)


def test_large_clusters_keep_their_links(spark):
    """One text in 400 versions, some of which are near a few others only: the same components as all pairs, at any chunk."""
    rnd, rows = random.Random(2), []
    base = [f"b{i}" for i in range(120)]
    for i in range(400):
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"chunk": 20_000}, {"tile_rows": 50}):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(d, **options).collect()}
        assert sum(got[i] != root[i] for i in range(400)) <= (1 if options else 0)


def test_shared_ids_keep_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    d = spark.createDataFrame([(1, one), (1, two), (1, two), (2, two), (None, one)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.first) for r in simhash.near_copies(d).where("doc_id is not null").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_bands_meet_at_the_threshold():
    """Of pairs of similarity 0.8 (by brute force) at least 99 % share a band and lie within the radius."""
    rng, met = np.random.default_rng(3), 0
    for _ in range(500):
        n = int(rng.integers(4, 300))
        h = rng.integers(0, 1 << 63, n + -(-n // 4), np.uint64)
        a, b = np.unique(h[:n]), np.unique(h[: n + n // 4])
        far = np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum()
        met += bool((simhash.bands(a) == simhash.bands(b)).any()) and far <= simhash.RADIUS
    assert met >= 495


def test_full_keys_lose_no_pair(spark):
    """All rows of a key meet, in groups that stay small: a key of 400 rows and a limit of 60, beside a small one."""
    rows = [(1, i, 1) for i in range(400)] + [(2, i, 1) for i in range(20)]
    dealt = simhash._dealt(spark.createDataFrame(rows, "k long, node long, weight int"), 60).collect()
    groups: dict = {}
    for r in dealt:
        groups.setdefault((r.k, r.c), []).append(r.node)
    assert max(map(len, groups.values())) <= 180
    met = {(k, *sorted((a, b))) for (k, _), nodes in groups.items() for a in nodes for b in nodes if a < b}
    assert met == {(1, a, b) for a in range(400) for b in range(a + 1, 400)} | {(2, a, b) for a in range(20) for b in range(a + 1, 20)}
