"""Each stage of the pipeline on awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import test_operators as brute
from compare import DATA

import corpus_pipeline
from loomquant.llm import host_quality

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __llm_kept string, spans string"


@pytest.fixture(scope="module")
def awkward():
    rows = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), "own", "clash") for r in brute.corpus(11)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(4)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(name, spark, frame):
    out = STAGES[name](spark, frame.where("false"), DATA)
    assert out.count() == 0
    if name != "byte-level BPE":
        assert out.columns == frame.columns


def test_quality_rules(spark, frame, awkward):
    """A document stays if the operator keeps it; texts and columns are as they were."""
    judged = Counter((r["doc_id"], r["text"]) for r in host_quality.judge(frame, keep=["doc_id", "text"], prefix="q_").where("q_kept").collect())
    out = STAGES["quality rules"](spark, frame, DATA)
    got = out.collect()
    assert out.columns == frame.columns and Counter((r["doc_id"], r["text"]) for r in got) == judged
    assert all(r["__llm_kept"] == "own" and r["spans"] == "clash" for r in got)
    for _, text in judged:
        n, _, _, _, repeat, _ = brute.counts_brute(text)
        assert n >= 20 and 100 * repeat <= 30 * n


def test_line_dedup(spark, frame, awkward):
    got = STAGES["line dedup"](spark, frame, DATA).collect()
    want = Counter((k[0], k[3]) for k, n in brute.line_brute(awkward).items() for _ in range(n))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got) == want
    assert all(r["__llm_kept"] == "own" and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in awkward)


def test_near_duplicates(spark, frame, awkward):
    got = STAGES["n-gram Jaccard join"](spark, frame, DATA).collect()
    sets = [brute.shingles(r["text"]) for r in got]
    assert not any(a and 100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    parts = {c for (_, n, c) in brute.components_brute(awkward) if n}
    assert {r["doc_id"] for r, s in zip(got, sets, strict=True) if s} == parts
    assert sum(not s for s in sets) == sum(not brute.shingles(r[1]) for r in awkward)


def test_decontamination(spark, tmp_path, awkward):
    items = [("a", " ".join((awkward[0][1] or "").split()[:14])), ("b", "one two three four five"), ("c", None), ("d", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame(awkward, SCHEMA)
    got = STAGES["benchmark decontamination"](spark, frame, str(tmp_path)).collect()
    hits = Counter(brute.contamination_brute(awkward, items))
    left = Counter((r["doc_id"], len(re.findall(brute.ALNUM_WORD, brute.lower(r["text"] or "")))) for r in got)
    assert left == Counter((k[0], k[1] - k[2]) for k, n in hits.items() for _ in range(n)) and sum(k[2] > 0 for k in hits) >= 2


def test_tokens(spark, frame, awkward):
    import tiktoken

    from loomquant.llm.queries import tokenizer

    v = tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    want = Counter()
    for r in awkward:
        ids = np.array(encoding.encode_ordinary(r[1] or ""), "<u4")
        want[r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in STAGES["byte-level BPE"](spark, frame, DATA).collect()) == want
