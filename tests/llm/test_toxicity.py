import random

import numpy as np
import pytest

from quire.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("written", ["idiooot", "i d i o t", "i.d.i.o.t", "m0r0n", "$tup1d", "tr@sh", "p4th3t1c", "w0rthl3ss", "s-c-u-m", "cl0wn"])
def test_decoding(model, written):
    meant = {"idiooot": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "tr@sh": "trash", "p4th3t1c": "pathetic", "w0rthl3ss": "worthless", "s-c-u-m": "scum", "cl0wn": "clown"}[written]
    assert meant in toxicity.Decoder(model).text(f"the {written} of and").split()


@pytest.mark.parametrize("written, meant", [("idio7", "idiot"), ("worthle55", "worthless"), ("worthle$$", "worthless"), ("disgustin9", "disgusting"), ("IdiOoOt", "idiot"), ("idiioott", "idiot"), ("ssttuuppiidd", "stupid"), ("cloown", "clown")])
def test_decoding_of_signs_at_the_end_and_of_doubled_letters(model, written, meant):
    assert meant in toxicity.Decoder(model).text(f"the {written} of and").split()


def test_punctuation_and_single_doublings_stay(model):
    assert toxicity.word_line(toxicity.Decoder(model).text("the idiot!! worthless and")).split() == ["the", "idiot", "worthless", "and"]


def test_plain_text_stays(model):
    t = "The price was 20 euros, e-mail me at noon.\nThanks 100%"
    assert toxicity.Decoder(model).text(t) == t.lower()


def test_long_runs_are_decoded_whole(model):
    meant = "thisisanidiotand" * 30
    for gap in " .":
        got = toxicity.Decoder(model).text(gap.join(meant))
        assert got.replace(" ", "") == meant and got.count(" idiot") == 30
    assert toxicity.Decoder(model).text("x" * 196 + "/w0rthl3ss/x").split()[-2] == "worthless"


def test_spelled_words_have_no_other_endings(model):
    got = toxicity.Decoder(model).text("the t h e r a p i s t came")
    assert "rapist" not in got.split() and got.replace(" ", "") == "thetherapistcame"


def every_path(model, run):
    """(cost, text) of each way through the lattice of a short run, none left out; the costs are those that restore() names."""
    low = run.lower()
    plain = [i for i, c in enumerate(low) if c.isalnum() or (c in toxicity.SIGNS and c not in toxicity.EDGE)]
    lo, hi = (plain[0], plain[-1]) if plain else (0, -1)
    pairs = sum(x == y and x.isalpha() for x, y in zip(low, low[1:]))
    lm = lambda a, b, c: float(model[tuple(toxicity.code(x) if x else 0 for x in (a, b, c))])

    def walk(i, p, q, cost, text):
        if i == len(low):
            yield cost + float(model[toxicity.code(p) if p else 0, toxicity.code(q) if q else 0, 0]), text
            return
        c, inner = low[i], 0 < i < len(low) - 1
        ways = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SIGN_COST * (2 if c == "*" else 1)) for x in toxicity.SIGNS.get(c, "")]
        if not c.isalpha() and c in toxicity.GAPS and inner:
            ways += [("", toxicity.GAP_COST), (" ", toxicity.WORD_COST)]
        elif not c.isalpha():
            outside = c in toxicity.EDGE and not lo < i < hi
            ways.append((" ", 0.0 if c not in toxicity.SIGNS or outside else toxicity.KEEP_COST if inner else toxicity.EDGE_COST))
        for x, extra in ways:
            if x == "" or (x == " " and q in ("", " ")):
                yield from walk(i + 1, p, q, cost + extra, text)
            else:
                yield from walk(i + 1, q, x, cost + extra + lm(p, q, x), text + x)
        same = i > 0 and c == low[i - 1]
        thrice = same and (low[i + 1 : i + 2] == c or (i > 1 and low[i - 2] == c))
        if (thrice and q and q != " ") or (same and not thrice and c.isalpha() and q == c):
            yield from walk(i + 1, p, q, cost + (toxicity.REPEAT_COST if thrice else toxicity.DOUBLE_COST if pairs > 1 else toxicity.LONE_COST), text)

    return list(walk(0, "", "", 0.0, ""))


@pytest.mark.parametrize("run", ["1d10t", "m0r0n", "$h!t", "l.o.s.e.r", "coool", "aabb", "b*d", "(1!)", "@", "7-4", "xx|1", "a. b", "0000"])
def test_viterbi_finds_the_cheapest_of_all_paths(model, run):
    paths = every_path(model, run)
    least = min(cost for cost, _ in paths)
    assert toxicity.Decoder(model).restore(run) in {text for cost, text in paths if cost <= least + 1e-4}


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where(toxicity.held_out()).join(labels, "doc_id").select("toxic", "predicted").collect()
    bad = [r.predicted for r in scored if r.toxic == 1]
    good = [r.predicted for r in scored if r.toxic == 0]
    assert sum(bad) >= 0.85 * len(bad) and sum(good) <= 0.01 * len(good)


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(6, 1, 1), (7, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.score(edge, toxicity.fit(edge, rows)).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_workers_get_few_bytes_at_once(spark):
    """Texts of a hundred megabytes in one partition come to a worker in batches of about four."""
    from pyspark.sql import functions as F

    from quire.functions.tables import small_batches

    small_batches(spark)
    texts = spark.range(0, 5_000, 1, 1).select(F.repeat(F.lit("abcd"), 5_000).alias("t"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 12_000_000


def test_ends_of_runs_are_restored_once(monkeypatch):
    model = -np.log(np.random.default_rng(4).dirichlet(np.ones(toxicity.A), toxicity.A**2)).astype(np.float32).reshape((toxicity.A,) * 3)
    rnd, decoder, calls = random.Random(4), toxicity.Decoder(model), []
    likeliest = decoder.likeliest
    monkeypatch.setattr(decoder, "likeliest", lambda low: calls.append(low) or likeliest(low))
    assert [decoder.restore("textile***"), decoder.restore("Aile***")] == [likeliest("textile***"), likeliest("aile***")]
    assert calls == ["le***"]
    for _ in range(2000):
        run = "".join(rnd.choice("abcdeab1*.$!é,'") for _ in range(rnd.randrange(1, 12)))
        assert decoder.restore(run) == likeliest(run)
