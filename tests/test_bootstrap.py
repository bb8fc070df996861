"""Sequential draws: their distribution, their memory, and the labels that they give."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from loomquant.operators import ensembles, weights


def test_three_draws_follow_the_definition():
    starts, ends, counts = np.array([0, 2, 2, 7]), np.array([2, 3, 8, 7]), np.array([1, 2, 1, 3])

    def shares(drawn: list[int]) -> np.ndarray:
        c = np.ones(9)
        for i in drawn:
            c[starts[i] : ends[i] + 1] += 1
        u = counts * np.array([np.mean(1 / c[s : e + 1]) for s, e in zip(starts, ends, strict=True)])
        return u / u.sum()

    rng, n, seen = np.random.default_rng(3), 20_000, np.zeros((4, 4, 4))
    for _ in range(n):
        seen[tuple(np.concatenate(list(weights.draw_spans(starts, ends, counts, 9, 3, rng))))] += 1
    want = np.array([[shares([])[a] * shares([a])[b] * shares([a, b]) for b in range(4)] for a in range(4)])
    assert np.abs((seen / n - want) / np.sqrt(want * (1 - want) / n)).max() < 4.5


def test_memory_does_not_follow_covered_bars():
    rng = np.random.default_rng(0)
    starts = rng.integers(0, 1000, 300)
    tracemalloc.start()
    picks = weights.sequential_draws(starts, starts + 20_000, 21_001, 50, rng)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(picks) == 50 and peak < 16e6  # the bars of all spans would take 48 MB for each array


def test_labels_of_shared_spans(spark):
    rows = [("A", i, i % 3, i % 3 + 2) for i in range(3000)] + [(None, 5000 + i, 7, 7) for i in range(40)]
    spans = spark.createDataFrame(rows, "symbol string, id long, start int, end int")
    got = weights.sequential_bootstrap(spans, replicates=2, seed=4).toPandas()
    for symbol, n in (("A", 3000), (None, 40)):
        of = got[got["symbol"].isna()] if symbol is None else got[got["symbol"] == symbol]
        for _, one in of.groupby("replicate"):
            assert sorted(one["draw"]) == list(range(n))
            assert 0.58 < one["id"].nunique() / n < 0.68 or symbol is None  # as with replacement among equal spans
            assert one["id"].between(5000, 5039).all() if symbol is None else (one["id"] < 3000).all()
    again = weights.sequential_bootstrap(spans.repartition(5), replicates=2, seed=4).toPandas()
    key = ["symbol", "replicate", "draw", "id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    with pytest.raises(Exception, match="ends before"):
        weights.sequential_bootstrap(spark.createDataFrame([("A", 1, 3, 2)], spans.schema)).collect()


def test_bags_of_many_labels_of_few_spans(spark):
    spans = spark.range(20_000).selectExpr("id", "id % 10 AS start", "id % 10 + 500 AS end")
    drawn = ensembles.draw_bags(spans, 3, 6000, seed=2)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("FlatMapGroupsInArrow") :]  # tasks get a row for each distinct span
    bags = drawn.toPandas()
    assert bags.groupby("estimator").size().tolist() == [6000] * 3 and bags["id"].between(0, 19_999).all()
