"""Toxicity scores of deobfuscated text.

A noisy channel writes letters as look-alike signs, puts spaces or dots between them or repeats
them. Each suspicious run (words that mix letters with signs, repeat a letter or are spelled out) becomes a lattice of the letters it may stand for, and the Viterbi path
under a character trigram model of the whole corpus restores it. The restored text is scored by a
logistic regression over word beginnings and words that training documents of label 1 favour.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.tables import small_batches
from quire.llm.store import cut

# Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou"}
GAPS = " .-_*"
EDGE = "!|+(*"  # signs that are often plain punctuation at the edge of a word
A = 64  # characters of the model: 0 no letter, 1-26 a-z, 27-62 other letters of all scripts by code point modulo 36, 63 digits
SIGN_COST, GAP_COST, WORD_COST, REPEAT_COST, DOUBLE_COST, LONE_COST, KEEP_COST, EDGE_COST = 1.0, 0.3, 4.0, 0.7, 5.0, 10.0, 6.0, 6.0

NOT_LETTERS = re.compile(r"[\W\d_]+")
DOUBLES = re.compile(r"(.)(?=\1)", re.DOTALL)


def code(c: str) -> int:
    """A lower-case character's class in the model."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 36 if c.isalpha() else 63 if c.isdigit() else 0


class _Codes(dict):
    """Classes of characters, looked up once each."""

    def __missing__(self, c: str) -> int:
        self[c] = code(c)
        return self[c]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Bits of each character: 1 letter, 2 sign, 4 gap, 8 white space."""
    chars = [chr(i) for i in range(0x10000)]
    return np.array([c.isalpha() | (c in SIGNS) << 1 | (c in GAPS) << 2 | c.isspace() << 3 for c in chars], np.uint8)


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.array([code(chr(i).lower()[0]) for i in range(0x10000)], np.int64)


@lru_cache(1)
def _lower() -> np.ndarray:
    return np.array([ord(chr(i).lower()[0]) for i in range(0x10000)], np.uint32)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the model's trigrams in all texts of a partition."""
    counts = np.zeros(A**3, np.int64)
    for b in batches:
        for text in b.column(0):
            t = text.as_py()
            if not t:
                continue
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            x = _codes()[np.minimum(cp, 0xFFFF)]
            x = np.r_[0, 0, x, 0]
            counts += np.bincount((x[:-2] * A + x[1:-1]) * A + x[2:], minlength=A**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"gram": at.astype(np.int32), "n": counts[at]})


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log-probabilities [before 2, before 1, character], from all documents: at most 64 ** 3 sums come back."""
    got = docs.select(text_col).mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    c = np.zeros(A**3)
    c[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    c = c.reshape(A, A, A)
    bi, uni = c.sum(0), c.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + A)
    p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
    p3 = (c + 8 * p2[None]) / (c.sum(2, keepdims=True) + 8)
    return -np.log(p3).astype(np.float32)


class Decoder:
    """Viterbi decoding of suspicious runs under a character model."""

    def __init__(self, model: np.ndarray):
        self.cost = model.ravel().tolist()  # at (before 2 * A + before 1) * A + character
        self.code = _Codes()
        self.known: dict[str, str] = {}
        self.ends: dict[str, str] = {}

    def restore(self, run: str) -> str:
        """The likeliest letters behind a run; of letters ahead that aren't repeated only the last two matter to what follows."""
        low, at, last = run.lower(), 0, ""
        while at < len(low) and (x := low[at]).isalpha() and x != last:
            at, last = at + 1, x
        if at == len(low):
            return low
        head, end = low[: max(0, at - 2)], low[max(0, at - 2) :]
        out = self.ends.get(end)
        if out is None:
            if len(self.ends) > 50_000:
                self.ends.clear()
            out = self.likeliest(end)
            if len(end) <= 200:  # only what is remembered depends on the length
                self.ends[end] = out
        return head + out

    def likeliest(self, low: str) -> str:
        """The likeliest letters behind a run in lower case; states are the last two characters written."""
        cost, code_of = self.cost, self.code
        lo, hi = 0, -1
        if not low.isalpha():
            plain = [i for i, c in enumerate(low) if c.isalnum() or c in SIGNS and c not in EDGE]
            lo, hi = (plain[0], plain[-1]) if plain else (0, -1)  # signs of EDGE outside are likely punctuation
        doubled = None
        states = {("", ""): (0.0, None, 0)}  # of the last two characters: cost, what is written, place of the next costs
        before, i, size = "", -1, len(low)
        while (i := i + 1) < size:
            c = low[i]
            if len(states) == 1:  # there is one way as far as letters follow that aren't repeated; its cost decides nothing
                end, last = i, before
                while end < size and (x := low[end]).isalpha() and x != last:
                    end, last = end + 1, x
                if end > i:
                    [((p, q), (_, text, base))] = states.items()
                    for x in low[max(i, end - 2) : end]:
                        p, q, base = q, x, ((base & A * A - 1) + code_of[x]) * A
                    states, before, i = {(p, q): (0.0, (low[i:end], text), base)}, q, end - 1
                    continue
            letter = c.isalpha()
            if letter and c != before:  # one way to go on
                before, cx, new = c, code_of[c], {}
                for key, (so_far, text, base) in states.items():
                    to, total = (key[1], c), so_far + cost[base + cx]
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (c, text), ((base & A * A - 1) + cx) * A)
                states = new
                continue
            if letter:
                if doubled is None:
                    doubled = DOUBLE_COST if sum(map(str.isalpha, DOUBLES.findall(low))) > 1 else LONE_COST  # one is common spelling
                arcs = ((c, code_of[c], 0.0),)  # (what is written, its class, channel cost)
            else:
                inner = 0 < i < len(low) - 1
                arcs = [(x, code_of[x], SIGN_COST if c != "*" else 2 * SIGN_COST) for x in SIGNS.get(c, "")]
                if c in GAPS and inner:
                    arcs += [("", 0, GAP_COST), (" ", 0, WORD_COST)]
                else:
                    arcs.append((" ", 0, 0.0 if c not in SIGNS or c in EDGE and not lo < i < hi else KEEP_COST if inner else EDGE_COST))
            thrice = c == before and (low[i + 1 : i + 2] == c or low[i - 2 : i - 1] == c and i > 1)
            twice = c == before and not thrice and letter
            before = c
            new: dict = {}
            for key, (so_far, text, base) in states.items():
                q = key[1]
                for x, cx, extra in arcs:
                    if x == "" or (x == " " and q in ("", " ")):
                        to, found = key, (so_far + extra, text, base)
                    else:  # what is written, what was written before
                        to, found = (q, x), (so_far + extra + cost[base + cx], (x, text), ((base & A * A - 1) + cx) * A)
                    if to not in new or found[0] < new[to][0]:
                        new[to] = found
                if (thrice and q and q != " ") or (twice and q == c):  # a repeated sign may write nothing
                    again = so_far + (REPEAT_COST if thrice else doubled)
                    if key not in new or again < new[key][0]:
                        new[key] = (again, text, base)
            states = new
        _, at, _ = min(states.values(), key=lambda s: s[0] + cost[s[2]])
        written = []
        while at is not None:
            x, at = at
            written.append(x)
        return "".join(reversed(written))

    def run(self, run: str) -> str:
        """A suspicious stretch between white space, restored."""
        out = self.known.get(run)
        if out is None:
            if len(self.known) > 50_000:
                self.known.clear()
            out = self.restore(run)
            low = run.lower()
            if out != low and word_line(out) == word_line(low):  # its letters stay, so its punctuation does
                out = low
            if len(run) <= 200:  # only what is remembered depends on the length
                self.known[run] = out
        return out

    def text(self, text: str) -> str:
        """A whole text in lower case with suspicious runs restored."""
        if len(text) < 3:
            return text.lower()
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bmp = np.minimum(cp, 0xFFFF)
        kind = _kinds()[bmp]
        letter, sign, gap, space = (kind & k > 0 for k in (1, 2, 4, 8))
        hit = np.zeros(len(cp), bool)
        low = _lower()[bmp]
        hit[1:] |= letter[1:] & (low[1:] == low[:-1]) & (cp[1:] < 0x10000)  # a letter twice
        word = np.cumsum(space)  # number of each character's word
        mixed = np.bincount(word[letter], minlength=word[-1] + 1).astype(bool) & np.bincount(word[sign], minlength=word[-1] + 1).astype(bool)
        hit |= (letter | sign) & mixed[word]
        one = letter | sign
        if len(cp) >= 5:  # a letter between gaps, twice in a row
            hit[4:] |= one[4:] & gap[3:-1] & one[2:-2] & gap[1:-3] & one[:-4]
        at = np.flatnonzero(hit)
        if not len(at):
            return text.lower()
        edges = np.flatnonzero(space)
        lo = np.r_[0, edges + 1][np.searchsorted(edges, at)]
        hi = np.r_[edges, len(cp)][np.searchsorted(edges, at)]
        single = np.flatnonzero(one & np.r_[True, space[:-1]] & np.r_[space[1:], True])  # letters that stand alone
        out, done = [], 0
        for a, b in dict.fromkeys(zip(lo.tolist(), hi.tolist())):
            if a < done:
                continue
            if b - a == 1:  # a run of letters that stand alone
                i = int(np.searchsorted(single, a))
                while i > 0 and single[i - 1] >= max(done, a - 2) and single[i - 1] == a - 2:
                    i, a = i - 1, a - 2
                i = int(np.searchsorted(single, b - 1))
                while i + 1 < len(single) and single[i + 1] == b + 1:
                    i, b = i + 1, b + 2
            out += [text[done:a].lower(), self.run(text[a:b])]
            done = b
        out.append(text[done:].lower())
        return "".join(out)


def word_line(text: str) -> str:
    """Words of letters, each with one space before it and after."""
    return " " + NOT_LETTERS.sub(" ", text).strip() + " "


def word_features(line: str) -> set[str]:
    """Words (marked at both ends) and their beginnings of 4 to 7 letters; a digit ahead says how often, up to 3 times."""
    counts: dict[str, int] = {}
    for w in line.split():
        for f in (f" {w} ", *(f" {w[:k]}" for k in range(4, min(8, len(w))))):
            counts[f] = counts.get(f, 0) + 1
    return {f"{k}{f}" for f, n in counts.items() for k in range(1, min(n, 3) + 1)}


class Scorer:
    """Restores and scores texts: decoder, features, weights."""

    def __init__(self, model: np.ndarray, features: list[str], weights: np.ndarray, bias: float):
        self.model, self.features, self.weights, self.bias = model, features, weights, bias
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _machine(self):
        if self._ready is None:
            automaton = ahocorasick.Automaton()
            for i, f in enumerate(self.features):
                core = f[1:].strip()
                automaton.add_word(core, [*automaton.get(core, []), (i, len(core), f[-1] == " ")])
            if self.features:
                automaton.make_automaton()
            self._ready = Decoder(self.model), automaton
        return self._ready

    def present(self, text: str | None) -> list[int]:
        """Numbers of the features in a text."""
        return self.present_in(self._machine()[0].text(text)) if text and self.features else []

    def present_in(self, text: str) -> list[int]:
        """Numbers of the features in a decoded text."""
        automaton, found = self._machine()[1], {}
        if not text or not self.features:
            return []
        for end, hits in automaton.iter(text):
            for i, size, whole in hits:
                if (end < size or not text[end - size].isalpha()) and text[end + 1 : end + 2].isalpha() != whole:
                    found[i] = found.get(i, 0) + 1
        return sorted(i for i, n in found.items() if n >= int(self.features[i][0]))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return 1 / (1 + float(np.exp(-min(max(z, -30), 30))))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents that aren't held out, those whose ids hash lowest."""
    ids = labels.where("toxic is not null").where(~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(most)
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return docs.join(F.broadcast(ids), "__id").select("text", F.col("__y").cast("int").alias("toxic"))


def _decoded(decoder_model: np.ndarray):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(decoder_model)
        for b in batches:
            texts = [decoder.text(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(1)], names=["text", "toxic"])

    return decode


def _counted(wanted: frozenset | None):
    """Decoded texts -> how many hold each feature, or each wanted one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        starts = None if wanted is None else {f[1:] for f in wanted}
        for b in batches:
            for t in b.column(0):
                line = word_line(t.as_py())
                if starts is not None:  # words without a wanted beginning hold no feature
                    line = " ".join(w for w in line.split() if f" {w[:4]}" in heads or f" {w} " in starts)
                found = word_features(line)
                for f in found if wanted is None else found & wanted:
                    n[f] = n.get(f, 0) + 1
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    heads = {f[1:6] for f in wanted or ()}
    return count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000, features: int = 1_000) -> Scorer:
    """A scorer: the character model from all docs, features and weights from at most ``most`` labelled rows.

    Features occur in two and in three hundredths of the training documents of label 1 and favour it twenty to one;
    the ``features`` strongest are kept (their candidates are few: none but those of three hundredths
    of the rows come to the driver). Without labelled rows of both kinds every score is near 1 where
    only label 1 is there, else near 0; the same holds for empty tables. Labels of null ids don't
    count; of an id labelled twice the larger counts; of rows with one id each is a training row;
    null texts are empty ones; texts are read whole; columns other than the two are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = language_model(docs, text_col)
    rows = cut(training_rows(docs, labels, id_col, text_col, most))
    size = {y: n for y, n in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Scorer(model, [], np.zeros(0), 30.0 if bad else -30.0)
    spread = rows.repartition(max(8, spark.sparkContext.defaultParallelism))
    narrow = cut(spread.select("text", "toxic").mapInArrow(_decoded(model), "text string, toxic int"))  # decoded once for all that follows
    of_bad = narrow.where("toxic = 1").select("text").mapInArrow(_counted(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("bad"))
    ranked = of_bad.where(F.col("bad") >= max(2, bad * 3 // 100))
    found = {r["f"]: r["bad"] for r in ranked.toLocalIterator()}
    of_good = narrow.where("toxic = 0").select("text").mapInArrow(_counted(frozenset(found)), "f string, n long").groupBy("f").agg(F.sum("n").alias("good"))
    clean = {r["f"]: r["good"] for r in of_good.collect()}
    odds = {f: np.log((n + 0.1) / (bad + 1)) - np.log((clean.get(f, 0) + 0.1) / (good + 1)) for f, n in found.items()}
    strong = sorted((f for f, x in odds.items() if x >= np.log(20)), key=lambda f: (-found[f] * odds[f], f))[:features]
    scorer = Scorer(model, sorted(strong), np.zeros(len(strong)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scorer.present_in(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"toxic": b.column(1), "f": pa.array(rows, pa.list_(pa.int32()))})

    table = narrow.mapInArrow(present, "toxic int, f array<int>").groupBy("toxic", "f").count().toArrow()  # at most ``most`` rows
    y, n = table.column("toxic").to_numpy().astype(float), table.column("count").to_numpy().astype(float)
    lists = table.column("f").to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.array([i for x in lists for i in x], np.int64)
    n *= np.where(y == 1, min(5.0, max(1.0, good / bad)), 1.0)  # the rarer label counts for more
    w, bias, total = np.zeros(len(strong)), 0.0, n.sum()
    seen = np.bincount(col, n[row], minlength=len(w))
    for _ in range(400):  # damped steps, each feature's by its own curvature; a prior of variance 2 shrinks rare ones
        z = bias + np.bincount(row, w[col], minlength=len(lists))
        miss = n * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        w += 0.2 * (np.bincount(col, miss[row], minlength=len(w)) - 0.5 * w) / (0.25 * seen + 0.5)
        bias += 0.5 * miss.sum() / (0.25 * total)
    scorer.weights, scorer.bias = w, bias
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), a row for each row.

    A null text counts as empty and scores as one; texts are scored whole; equal texts score alike;
    an empty table gives no rows. Other columns stay, but for those named like the new ones in any case.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*names, of(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
