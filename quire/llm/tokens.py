"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from quire.llm.bpe import ODD, VOCABULARY, byte_letters, pieces

KEPT = 350_000  # pieces that a worker remembers
AT_ONCE = 1 << 20  # characters that are cut at once
LETTER, DIGIT, SIGN, BLANK, SPACE = range(5)  # blanks are other white space


@cache
def _kinds() -> np.ndarray:
    """Kinds of the characters that the pattern for Latin text knows."""
    plain = {9, 10, 11, 12, 13, 0xA0}
    letter = lambda i: chr(i).isascii() and chr(i).isalpha() or i in (0xAA, 0xB5, 0xBA) or i >= 0xC0 and i not in (0xD7, 0xF7)
    return np.array([SPACE if i == 32 else BLANK if i in plain else DIGIT if 48 <= i < 58 else LETTER if letter(i) else SIGN for i in range(0x250)], np.uint8)


def cuts(cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where pieces of Latin texts begin, as the pattern cuts them; the texts' code points stand one behind the other, begins are their first places."""
    kind = _kinds()[cp]
    group = np.minimum(kind, BLANK)
    first, start = np.zeros(len(cp) + 3, bool), np.zeros(len(cp) + 3, bool)
    first[begins] = first[len(cp) :] = True
    start[1 : len(cp)] = group[1:] != group[:-1]
    start |= first
    # the last of a run of white space before something else: a space goes with what follows, others stand alone
    last = np.flatnonzero((group[:-1] == BLANK) & start[1 : len(cp)] & ~first[1 : len(cp)])
    start[last] = True
    start[last[kind[last] == SPACE] + 1] = False
    # an apostrophe at the start of a piece takes some endings
    at = np.flatnonzero((cp == ord("'")) & start[: len(cp)])
    at = at[~first[at + 1]]
    one, two = cp[at + 1], np.where(first[at + 2], 0, cp[np.minimum(at + 2, len(cp) - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[np.r_[at[short], at[long]] + 1] = False
    start[np.r_[at[short] + 2, at[long] + 3]] = True
    return np.flatnonzero(start[: len(cp)])


class _Pieces(dict):
    """Ids of pieces; a piece that isn't known yet goes to the library."""

    def __init__(self, tokenize, ids: list[bytes]):
        self.tokenize, self.ids, self.letters = tokenize, ids, dict(enumerate(byte_letters()))
        self.space = self.letters[32]
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Of too many pieces those go that weren't met again since the last time."""
        if len(self) > KEPT // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is not None:
            self[piece] = found
            return found
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.space)
        else:
            spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = self.ids
        found = self[piece] = b"".join([ids[t.id] for t in self.tokenize(spelled)])
        return found


class LibraryEncoder:
    """Ids of whole texts as the library gives them; a piece between the pattern's cuts is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        size = self.whole.get_vocab_size()
        self.width = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.known = _Pieces(self.whole.model.tokenize, [i.to_bytes(self.width.itemsize, "little") for i in range(size)])

    def encode(self, text: str) -> bytes:
        """Ids as integers of self.width."""
        if any(s in text for s in self.special):  # the library finds special tokens before the pattern does
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        self.known.forget()
        return b"".join(map(self.known.__getitem__, pieces(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; many are cut together, and each distinct piece of theirs is looked up once."""
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > AT_ONCE or ODD.search(text) or any(s in text for s in self.special):
                out[i] = self.encode(text)
            elif text:
                some.append(i)
                size += len(text)
            if size >= AT_ONCE or some and i == len(texts) - 1:
                for k, ids in zip(some, self._together([texts[k] for k in some])):
                    out[k] = ids
                some, size = [], 0
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of Latin texts, none of them empty."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        at = cuts(cp, begins)
        offsets = np.append(at, len(cp)).astype(np.int32)
        offsets[1:] += np.cumsum(cp > 0x7F, dtype=np.int32)[offsets[1:] - 1]  # characters of two bytes
        found = pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())]).dictionary_encode()
        self.known.forget()
        ids = list(map(self.known.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        flat, piece = np.frombuffer(b"".join(ids), self.width), found.indices.to_numpy()
        n = size[piece]
        total = np.r_[0, np.cumsum(n)]
        tokens = flat[np.repeat((np.cumsum(size) - size)[piece] - total[:-1], n) + np.arange(total[-1])]
        edges = [*total[np.searchsorted(at, begins)].tolist(), len(tokens)]
        return [tokens[a:b].tobytes() for a, b in zip(edges, edges[1:])]


@cache
def library_encoder(path: str | None = None) -> LibraryEncoder:
    return LibraryEncoder(path or public_tokenizers.path(VOCABULARY))
