import hashlib
import re

from .conftest import words

from quire.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=50):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i or 0, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def got(d, **kw):
    return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(d, **kw).collect())


def test_documents(docs):
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge, empty, edge_rows):
    assert got(edge) == plain(edge_rows)
    assert got(empty) == []


def test_small_filter_gives_the_same(spark):
    passage = words(80, 5)
    rows = [(i, words(40 + i, 100 + i) + " " + passage + " " + words(30, 200 + i)) for i in range(30)] + [(99, words(49, 100))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(d) == got(d, bits=8) == plain(rows)


def test_texts_without_repeats_stay_as_they_are(spark):
    d = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id long, text string")
    assert sorted(r.kept for r in substring.remove_repeats(d).collect()) == ["", "a  b\nc"]
