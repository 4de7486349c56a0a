import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, secret_scan, simhash, substring, toxicity

NAMES = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def passed(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        out[name] = docs
    return out


def rows(d):
    return {r.doc_id: r for r in d.collect()}


def test_stages_do_what_their_operators_say(spark, sf, passed):
    before, after = rows(passed["input"]), rows(passed["toxicity"])
    scorer = toxicity.fit(passed["input"], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(after) == {i for i, r in before.items() if scorer.score(r.text) < 0.5} and all(after[i] == before[i] for i in after)
    copies = {r.doc_id: r.first for r in simhash.near_copies(passed["toxicity"]).collect()}
    assert set(rows(passed["simhash"])) == {i for i, first in copies.items() if first}
    kept = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeats(passed["simhash"]).collect()}
    assert {i: r.text for i, r in rows(passed["substring"]).items()} == {i: k for i, (n, k) in kept.items()}
    found = secret_scan.scan(passed["secrets"]).select(F.explode("secret_spans").alias("s")).where("s.k < 3").count()
    assert found == 0
    assert passed["packing"].agg(F.countDistinct("doc_id")).first()[0] == passed["secrets"].count()


def test_columns_stay(passed):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert passed[name].columns == NAMES


def test_edges(spark, edge, empty, sf):
    for table in (edge.select(*NAMES), edge, empty.select(*NAMES)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= min(1, table.count())


def test_registered(spark, sf):
    assert [n.split("_")[0] for n in queries.QUERIES] and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert corpus_pipeline.run(spark, sf).count() > 0
