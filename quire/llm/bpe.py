"""Byte-level BPE, encoded and decoded from a public rank table.

A text is cut into pieces by the vocabulary's pattern; a piece is encoded by the contiguous rank
array method: part boundaries and the ranks of adjacent pairs lie side by side, the smallest rank
is looked for again and again, its boundary is deleted and the two neighbouring ranks are looked
up anew. Pieces that a worker has not met yet are encoded together, one array row for each piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)
KEPT = 400_000  # pieces that a worker remembers


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# Latin text without characters on which str.isalnum and \s differ from the vocabulary's pattern.
ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-ɏ]")
LATIN = re.compile(" ?[A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\sA-Za-z0-9\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-ɏ]+|\\s+(?!\\S)|\\s+")
ANY = regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """A text cut by the vocabulary's pattern."""
    return ANY.findall(text) if ODD.search(text) else LATIN.findall(text)


class Ranks:
    """Merges as a table from a pair of ids to (rank, id), by open addressing in numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        ids, merges = given["model"]["vocab"], given["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.text = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in given.get("added_tokens", [])}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.mask, self.keys = (1 << 19) - 1, np.full(1 << 19, -1, np.int64)
        self.rank, self.made = np.full(1 << 19, NONE, np.int32), np.zeros(1 << 19, np.int32)
        todo, step = np.arange(len(key)), 0
        while len(todo):  # a pair goes to the first free place after its own
            at = self._place(key[todo], step)
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            win = free[one]
            self.keys[at[win]], self.rank[at[win]], self.made[at[win]] = key[todo[win]], todo[win], made[todo[win]]
            todo, step = np.delete(todo, win), step + 1
        self.probes = step

    def _place(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key * 0x2545F4914F6CDD1D >> 40) + step) & self.mask

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of each adjacent pair; NONE where the two don't merge."""
        key = a.astype(np.int64) << 20 | b
        rank, made = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for step in range(self.probes):
            at = self._place(key[todo], step)
            there = self.keys[at]
            hit = there == key[todo]
            rank[todo[hit]], made[todo[hit]] = self.rank[at[hit]], self.made[at[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return rank, made

    def encode_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of a similar length; row r holds the parts of words[r] and the ranks between them."""
        n, width = len(words), max(map(len, words))
        size = np.array(list(map(len, words)))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        part = self.first[raw]
        rank, made = np.full((n, width), NONE, np.int32), np.zeros((n, width), np.int32)
        r, c = np.nonzero(np.arange(width - 1) < (size - 1)[:, None])
        rank[r, c], made[r, c] = self.look(part[r, c], part[r, c + 1])
        live, column = np.arange(n), np.arange(width)
        while len(live):
            best = rank[live].argmin(axis=1)
            go = rank[live, best] != NONE
            live, best = live[go], best[go]
            if not len(live):
                break
            part[live, best] = made[live, best]
            # the boundary after best goes: what lies behind moves one place to the left
            source = np.minimum(column + (column > best[:, None]), width - 1)
            part[live] = np.take_along_axis(part[live], source, 1)
            rank[live] = np.take_along_axis(rank[live], np.minimum(column + (column >= best[:, None]), width - 1), 1)
            made[live] = np.take_along_axis(made[live], np.minimum(column + (column >= best[:, None]), width - 1), 1)
            size[live] -= 1
            rank[live, size[live] - 1] = NONE
            for at in (best - 1, best):  # the neighbouring ranks
                ok = (at >= 0) & (at < size[live] - 1)
                i, j = live[ok], at[ok]
                rank[i, j], made[i, j] = self.look(part[i, j], part[i, j + 1])
        return [part[i, :k] for i, k in enumerate(size)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one long piece: all merges of the smallest rank in one sweep from left to right."""
        part = self.first[np.frombuffer(word, np.uint8)]
        while len(part) > 1:
            rank, made = self.look(part[:-1], part[1:])
            low = rank.min()
            if low == NONE:
                break
            at = np.flatnonzero(rank == low)
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1  # of overlapping pairs every other one merges
            start = at[np.r_[True, np.diff(at) > 1]]
            at = at[(at - start[run]) % 2 == 0]
            part[at] = made[at]
            part = np.delete(part, at + 1)
        return part


class Encoder:
    """Encodes texts with a memory of pieces; one for each worker and vocabulary."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.known: dict[str, bytes] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.ranks.special, key=len, reverse=True))) + ")") if self.ranks.special else None
        table = [self.ranks.text.get(i, b"") for i in range(max(self.ranks.text) + 1)]
        self.table = table

    def learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        order = sorted(range(len(new)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            size = len(raw[order[at]])
            if size > 64:
                self.known[new[order[at]]] = self.ranks.encode_long(raw[order[at]]).astype("<u4").tobytes()
                at += 1
                continue
            end = at
            while end < len(order) and end - at < 20_000 and len(raw[order[end]]) <= min(64, size + 3):
                end += 1
            chosen = order[at:end]
            for i, ids in zip(chosen, self.ranks.encode_rows([raw[i] for i in chosen])):
                self.known[new[i]] = ids.astype("<u4").tobytes()
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a special token's string is that token."""
        out = []
        for lo in range(0, len(texts), 256):
            cut = []
            for t in texts[lo : lo + 256]:
                parts = self.split.split(t) if self.split else [t]
                cut.append([x if k % 2 else pieces(x) for k, x in enumerate(parts)])
            if len(self.known) > KEPT:
                self.known.clear()
            new = {p for doc in cut for x in doc if isinstance(x, list) for p in x}
            new.difference_update(self.known)
            if new:
                self.learn(list(new))
            known, special = self.known, self.ranks.special
            out += [b"".join(special[x].to_bytes(4, "little") if isinstance(x, str) else b"".join(map(known.__getitem__, x)) for x in doc) for doc in cut]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD; unknown ids are left out."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column (array<int>); null as an empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i4") for x in encoder(path).encode([t or "" for t in texts])])

    return ids(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a column of token ids; null as no ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([encoder(path).decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in rows])

    return text(ids)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone.

    One row for each row of docs, repeated or null ids included; a null text is an empty one. Only
    the text goes to Python, and only three short columns come back. Other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        coder = encoder(path)
        rows = coder.encode([t or "" for t in texts])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in rows], "ids_sha256": [sha(x) for x in rows], "decoded_sha256": [sha(coder.decode(x).encode("utf-8", "surrogatepass")) for x in rows]})

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("d")).select(id_col, "d.*")
