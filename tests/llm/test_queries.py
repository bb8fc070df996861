"""The queries against their SQL, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from compare import DATA, assert_same

import corpus_pipeline
from loomquant.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark, duck):
    assert_same(queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_for_each_document(name, spark):
    got = queries.QUERIES[name](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_stages(spark, tmp_path):
    import test_operators as brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(path := str(tmp_path / str(k)))
        before, docs = rows, spark.read.parquet(path)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        got = docs.collect()
        rows = {r["doc_id"]: r["text"] for r in got}
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "quality rules":
            for d, text in before.items():
                n, _, _, _, repeat, _ = brute.counts_brute(text)
                if n < 20 or 100 * repeat > 30 * n:
                    assert d not in rows
            assert len(rows) > 0.7 * len(before) and all(before[d] == t for d, t in rows.items())
        elif name == "line dedup":
            want = {k[0]: k[3] for k in brute.line_brute([(d, t) for d, t in before.items()])}
            assert {d: brute.hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()} == want
        elif name == "n-gram Jaccard join":
            parts = brute.components_brute([(d, t) for d, t in before.items()])
            assert set(rows) == {d for d, n, c in parts if n == 0 or d == c}
        else:
            hits = {k[0]: k[2] for k in brute.contamination_brute([(d, t) for d, t in before.items()], items)}
            for d, text in rows.items():
                left = len(re.findall(brute.ALNUM_WORD, brute.lower(text)))
                assert left == len(re.findall(brute.ALNUM_WORD, brute.lower(before[d]))) - hits[d]


def test_run_gives_what_the_stages_give(spark):
    a = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert Counter(tuple(r) for r in a.collect()) == Counter(tuple(r) for r in docs.collect())
