"""What the search for repeats keeps on disk: nothing of passages under a window, nothing of copies."""

import pytest

from quire.llm import substring


@pytest.fixture
def kept(monkeypatch):
    rows = []

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    written = substring.written
    monkeypatch.setattr(substring, "written", counted)
    return rows


def _words(name, n):
    return [f"{name}{i}" for i in range(n)]


def _removed(spark, texts):
    d = spark.createDataFrame(list(texts), "doc_id long, text string")
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(d, bits=16).collect())


def test_passages_under_a_window_are_not_kept(spark, kept):
    a = _words("a", 100)
    b = _words("b", 60) + a[:40] + _words("c", 60)
    assert _removed(spark, [(1, " ".join(a)), (2, " ".join(b))]) == [(1, 100, 0, " ".join(a)), (2, 160, 0, " ".join(b))]
    assert kept == [0]


def test_copies_are_taken_out_by_their_first(spark, kept):
    a, short = " ".join(_words("a", 120)), " ".join(_words("s", 49))
    later = " ".join(_words("a", 120)[30:90] + ["end"])
    rows = [(5, a), (3, a), (9, a), (3, a), (7, short), (8, short), (4, later), (6, later), (None, a), (10, None), (11, "")]
    found = _removed(spark, [r for r in rows if r[0] is not None])
    assert found == [(3, 120, 0, a), (3, 120, 0, a), (4, 61, 60, "end"), (5, 120, 120, ""), (6, 61, 61, ""), (7, 49, 0, short), (8, 49, 0, short), (9, 120, 120, ""), (10, 0, 0, ""), (11, 0, 0, "")]
    assert kept[0] == 11  # windows of 50 of the 60 words that two different texts share
    null = spark.createDataFrame([(None, a), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(null, bits=16).collect()) == [(0, 0), (2, 0)]
