"""Kernels that keep their state between batches: one symbol in many batches gives what the whole gives."""

from __future__ import annotations

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from loomquant.operators import bars, filters, rolling
from loomquant.sources import domain


def pieces(n, rng):
    return np.split(np.arange(n), np.sort(rng.integers(0, n, 6)))


@pytest.mark.parametrize("name", ["sum", "time", "run", "imbalance", "cusum", "ewma", "std"])
def test_pieces_equal_the_whole(name):
    rng = np.random.default_rng(3)
    n = 300
    price = np.round(100 + rng.normal(0, 1, n).cumsum(), 1)
    volume, stamps = rng.integers(1, 9, n).astype(float), np.cumsum(rng.integers(1, 50, n))
    make, columns = {
        "sum": (lambda: bars.SumBars(40.0), (volume,)),
        "time": (lambda: bars.TimeBars(120), (stamps,)),
        "run": (lambda: bars.SignedBars(length=3), (price,)),
        "imbalance": (lambda: bars.SignedBars(threshold=12.0), (price, volume)),
        "cusum": (filters.Cusum, (price, np.full(n, 0.01))),
        "ewma": (lambda: rolling.Ewma(7), (price,)),
        "std": (lambda: rolling.EwStd(7), (price,)),
    }[name]
    whole = make()(*columns)
    for _ in range(5):
        state = make()
        parts = [state(*(c[p] for c in columns)) for p in pieces(n, rng) if len(p)]
        if isinstance(whole, tuple):
            for k in range(2):
                assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()
        else:
            assert np.concatenate(parts) == pytest.approx(whole)


def test_small_batches_change_nothing(spark):
    ticks = domain.ticks(spark, DATA)
    ticks = ticks.unionAll(ticks.where("ord % 2 = 0").withColumn("symbol", F.lit(None).cast("string")))
    queries = {
        "dollar": lambda: bars.dollar_bars(ticks, 5000.0),
        "time": lambda: bars.time_bars(ticks, "1h"),
        "imbalance": lambda: bars.imbalance_bars(ticks, 25.0, "volume"),
        "cusum": lambda: filters.cusum_filter(ticks.withColumnRenamed("price", "close"), 2.0),
        "ewma": lambda: rolling.ewma(ticks, "price", 5),
    }
    want = {k: sorted(map(str, q().collect())) for k, q in queries.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for k, q in queries.items():
            assert sorted(map(str, q().collect())) == want[k] and want[k]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
