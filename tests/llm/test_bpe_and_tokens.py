import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, packing, rans, tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", "a<|endoftext|>b <|endoftext|> ", "x" * 300, "ab" * 200, " \n\n  x\t\ty  ", "don't 'sx !'s 's  'll", "日本語 テキスト ²³ ½ \x1c \x85 x", "é" * 80, "🙂🙂 ok", "  \x1f  a", "1234567 89", "　　a", "<|x"]


def test_ids_equal_the_library(library):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab 's\n\t!1é日  ²") for _ in range(rnd.randrange(60))) for _ in range(500)]
    coder, other = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY)), tokens.library_encoder()
    for t, ids, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
        assert np.frombuffer(other.encode(t), other.width).tolist() == want.ids


def test_texts_together_have_the_library_s_ids(library, monkeypatch):
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("ab 's\n\tdtmrevl!1é \xa0  \'\'\'×'2") for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", ""]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for at_once, kept in ((1, 350_000), (50, 10), (10_000, 350_000)):
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        monkeypatch.setattr(tokens, "KEPT", kept)
        coder = tokens.LibraryEncoder(public_tokenizers.path(bpe.VOCABULARY))
        assert [np.frombuffer(x, coder.width).tolist() for x in coder.encode_all(texts)] == want
    assert coder.encode_all([]) == []
    calls = []
    coder.known.__class__ = type("Counted", (tokens._Pieces,), {"__getitem__": lambda self, p: calls.append(p) or tokens._Pieces.__missing__(self, p)})
    coder.encode_all(["one two"] * 500)
    assert sorted(calls) == [" two", "one"]  # each distinct piece is looked up once


def test_bpe_digests(edge, empty, edge_rows, library):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge).collect())
    want = []
    for i, t in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and bpe.digests(empty).count() == 0


def test_columns(spark, edge):
    from pyspark.sql import functions as F

    back = edge.select("text", bpe.decoded(bpe.encoded(F.col("text"))).alias("b")).collect()
    assert all(r.b == (r.text or "") for r in back)


def pieces_hold(rows, docs, library, end):
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in docs}
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.start)):
        w = ids[r.doc_id]
        assert r.doc_tokens == len(w) and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sum(n < 2048 for n in at.values()) <= 1 and max(at.values()) <= 2048
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_packing(edge, empty, docs, edge_rows, library):
    pieces_hold(packing.digests(edge).collect(), edge_rows, library, 1)
    pieces_hold(packing.digests(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], library, 1)
    assert packing.digests(empty).count() == 0


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        x = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        k = packing.hilbert_key(x, bits)
        assert sorted(k) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_rans_blocks_round_trip():
    rng = np.random.default_rng(1)
    table = rans.Table(np.r_[rng.integers(0, 1000, 300), np.zeros(10, int)])
    blocks = [rng.integers(0, 310, n).astype("<u2") for n in (0, 1, 31, 32, 33, 8191, 8192, 8193, 40_000)]
    payloads = rans.encode_blocks(blocks, table)
    for a, b in zip(blocks, rans.decode_blocks(payloads, table)):
        assert (a == b).all()
    bad = bytearray(payloads[5])
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(bad)], table)


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_rans_files(name, request, library):
    d = request.getfixturevalue(name)
    got = sorted(rans.digests(d).collect(), key=lambda r: r.start)
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in d.select("doc_id").collect())
    ids = {(r.doc_id, len(w), zlib.crc32(w.tobytes())) for r in d.select("doc_id", "text").collect() for w in [np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")]}
    at = 0
    for r in got:
        assert r.start == at and (r.doc_id, r.n_tokens, r.ids_crc32) in ids
        at += r.n_tokens
