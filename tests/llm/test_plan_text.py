"""What plans tell the driver: their text is in events, which should not follow the vocabulary."""

from __future__ import annotations

from loomquant.llm import byte_bpe
from loomquant.llm.queries import tokenizer


def test_plans_do_not_spell_out_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "unhappily encoded wordsmithery"), (2, None)], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, tokenizer(), keep=["doc_id"])
    plan = encoded._jdf.queryExecution()
    assert len(plan.executedPlan().toString()) < 50_000 and len(plan.optimizedPlan().toString()) < 50_000
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in encoded.collect()) == [(1, True), (2, False)]
