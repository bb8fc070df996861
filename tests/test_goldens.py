"""Known answers for the finance operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquant.functions import bet_sizing, normal, sharpe
from loomquant.operators import bars, breaks, dependence, entropy, etf, filters, labeling, learning, portfolio, rolling, signals, simulate, stats, validation, weights
from loomquant.plans import experiment, frames, pipeline
from loomquant.sources import ohlcv
from loomquant.streaming import early_warning

T0 = dt.datetime(2024, 1, 1, 9, 30)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def ticks(spark, rows):
    return spark.createDataFrame([("A", at(s), i, float(p), float(v)) for i, (s, p, v) in enumerate(rows)], "symbol string, ts timestamp_ntz, ord long, price double, volume double")


TRADES = [(0, 100, 1), (30, 101, 2), (60, 102, 3), (150, 103, 4), (210, 104, 5)]


@pytest.mark.parametrize(
    "build, want",
    [
        (lambda t: bars.tick_bars(t, 2), [(100, 101, 3, 302, 2), (102, 103, 7, 718, 2)]),
        (lambda t: bars.volume_bars(t, 5), [(100, 102, 6, 608, 3), (103, 104, 9, 932, 2)]),
        (lambda t: bars.dollar_bars(t, 500), [(100, 102, 6, 608, 3), (103, 104, 9, 932, 2)]),
        (lambda t: bars.time_bars(t, "120s"), [(100, 103, 10, 1020, 4), (104, 104, 5, 520, 1)]),
    ],
)
def test_standard_bars(spark, build, want):
    got = build(ticks(spark, TRADES)).orderBy("bar_id").collect()
    assert [(r["open"], r["close"], r["volume"], r["dollar_value"], r["n_obs"]) for r in got] == want


def test_run_and_imbalance_bars(spark):
    runs = ticks(spark, [(i, p, 1) for i, p in enumerate((100, 101, 102, 103, 102, 101, 100, 99, 98))])
    assert [(r["open"], r["close"], r["n_obs"]) for r in bars.run_bars(runs, 3).orderBy("bar_id").collect()] == [(100, 103, 4), (102, 99, 4)]
    imbalance = ticks(spark, [(i, p, 1) for i, p in enumerate((100, 101, 102, 101, 100, 101, 102, 103))])
    assert [(r["open"], r["close"], r["n_obs"]) for r in bars.imbalance_bars(imbalance, 2).orderBy("bar_id").collect()] == [(100, 102, 3), (101, 103, 5)]


def test_clean_report_and_align(spark):
    rows = [("AAPL", "2024-01-02", 185.0), ("AAPL", "2024-01-02", 186.0), ("AAPL", "2024-01-03", 187.0), ("MSFT", "2024-01-01", 370.0), ("MSFT", "2024-01-03", 371.0), ("AAPL", "2024-01-04", 188.0)]
    raw = spark.createDataFrame([(d, s, c, c + 1, c - 1, c, 100, c, i) for i, (s, d, c) in enumerate(rows)], "Date string, Ticker string, Open double, High double, Low double, Close double, Volume long, `Adj Close` double, k int")
    clean = ohlcv.clean_ohlcv(raw, ordinal="k")
    assert clean.count() == 5 and clean.where("symbol = 'AAPL' and ts = '2024-01-02'").first()["close"] == 186.0
    report = ohlcv.data_quality_report(raw, ordinal="k").first()
    assert (report["duplicate_key_count"], report["gap_interval_count"]) == (1, 1)
    msft = ohlcv.align_calendar(raw, interval="1d", ordinal="k").where("symbol = 'MSFT'").collect()
    assert len(msft) == 3 and sum(r["is_missing_bar"] for r in msft) == 1
    with pytest.raises(ValueError, match="missing required"):
        ohlcv.clean_ohlcv(raw.drop("Close"))
    with pytest.raises(ValueError):
        ohlcv.interval_seconds("1x")


def test_load_ohlcv(spark, tmp_path):
    path = str(tmp_path / "bars.csv")
    with open(path, "w") as f:
        f.write("timestamp,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:01:00,x,2,0.5,1.5,10\n")
    got = ohlcv.load_ohlcv(spark, path, symbol="Z").collect()
    assert len(got) == 1 and got[0]["symbol"] == "Z" and got[0]["adj_close"] == 1.5
    with pytest.raises(ValueError):
        ohlcv.load_ohlcv(spark, path)
    with pytest.raises(ValueError):
        ohlcv.load_ohlcv(spark, "a.json", symbol="Z")


def test_triple_barrier(spark):
    close = spark.createDataFrame([("A", at(60 * i), p) for i, p in enumerate((100.0, 100.2, 100.3, 100.4))], "symbol string, ts timestamp_ntz, close double")
    event = close.limit(1).select("symbol", "ts")
    target = event.withColumn("trgt", F.lit(0.01))
    vertical = labeling.add_vertical_barrier(event, close, minutes=1)
    events = labeling.triple_barrier_events(close, event, target, profit_taking=10, stop_loss=10, barriers=vertical)
    assert events.first()["t1"] == at(60) and labeling.triple_barrier_labels(events, close).first()["label"] == 1
    short = labeling.triple_barrier_events(close, event, target, profit_taking=10, stop_loss=10, barriers=vertical, side=event.withColumn("side", F.lit(-1.0)))
    assert labeling.meta_labels(short, close).first()["label"] == 0


def test_filters_fire():
    assert filters.Cusum()(np.array([100.0, 103.0, 103.1, 99.0, 99.1]), np.full(5, 0.02)).tolist() == [False, True, False, True, False]


def test_sampling_goldens(spark):
    ind = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 1), (3, 1), (4, 2), (5, 2)], "bar int, label int")
    unique = {r["label"]: r["u"] for r in weights.label_uniqueness(ind).groupBy("label").agg(F.avg("uniqueness").alias("u")).collect()}
    assert [round(unique[i], 4) for i in range(3)] == [0.8333, 0.75, 1.0]
    step = {r["label"]: r["average"] for r in weights.bootstrap_step(ind, spark.createDataFrame([(1,)], "label int")).collect()}
    total = sum(step.values())
    assert [round(step[i] / total, 8) for i in range(3)] == [0.35714286, 0.21428571, 0.42857143]
    picks = weights.sequential_draws(np.array([0, 2, 4]), np.array([2, 3, 5]), 6, 5, np.random.default_rng(0), [2, 1])
    assert picks[:2].tolist() == [1, 2]  # warm-up draws come from the end


def test_backtest_statistics(spark):
    def frame(values, name="position"):
        return spark.createDataFrame([("A", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], f"symbol string, ts timestamp_ntz, {name} double")

    flips = stats.flattening_and_flips(frame([1, 1.5, 0.5, 0, -0.5, -1, 0.5, 1.5, 1.5, 1.5])).orderBy("ts").collect()
    assert [r["ts"].day for r in flips] == [4, 7, 10]
    assert stats.average_holding_period(frame([0, 1, 1, -1, -1, 0, 0, 2, 2, 0])).first()["days"] == pytest.approx(2.0)
    assert stats.average_holding_period(frame([0, 1, 1, 1, 1, 2, 2, 2, 2, 2])).first()["days"] is None
    dips = stats.drawdown_and_time_under_water(frame([100, 110, 90, 100, 120, 130, 100, 120, 140, 130], "value"), dollars=True).orderBy("start").collect()
    assert [r["drawdown"] for r in dips] == [20, 30, 10]
    rets = frame([0.03, 0.02, 0.01, -0.01, 0.02, 0.01, 0, -0.01, 0.01], "ret")
    assert stats.sharpe_ratio(rets, 12, 0.005).first()["sharpe"] == pytest.approx(0.987483, abs=1e-2)
    assert stats.information_ratio(rets, 0.006, 12).first()["information_ratio"] == pytest.approx(0.733559, abs=1e-2)
    one = spark.range(1)
    psr = sharpe.probabilistic_sharpe_ratio(F.lit(1.14), F.lit(1.0), F.lit(250), F.lit(0.0), F.lit(3.0))
    trl = sharpe.minimum_track_record_length(F.lit(1.14), F.lit(1.0), F.lit(0.0), F.lit(3.0), 0.05)
    bench = sharpe.expected_max_sharpe(F.lit(0.4), 100)
    row = one.select(psr.alias("p"), trl.alias("t"), bench.alias("b")).first()
    assert row["p"] == pytest.approx(0.95727, abs=1e-3) and row["t"] == pytest.approx(228.73497, abs=0.1) and row["b"] == pytest.approx(1.012241, abs=1e-3)


def test_bet_sizing(spark):
    prob, side = (0.55, 0.70, 0.95, 0.65, 0.85), (1, -1, 1, -1, 1)
    day = dt.datetime(2000, 1, 1)
    events = spark.createDataFrame([("A", i, day + dt.timedelta(days=i), day + dt.timedelta(days=i + 1 + i / 2), p, float(s)) for i, (p, s) in enumerate(zip(prob, side, strict=True))], "symbol string, id int, start timestamp_ntz, end timestamp_ntz, prob double, side double")
    want = [0.0800556, -0.3374794, 0.9610525, -0.2468476, 0.6730107]
    assert [r["size"] for r in signals.bet_size_probability(events).orderBy("ts").collect()] == pytest.approx(want, abs=1e-6)
    assert [r["size"] for r in signals.bet_size_probability(events, step_size=0.1).orderBy("ts").collect()] == pytest.approx([0.1, -0.3, 1.0, -0.2, 0.7])
    active = signals.bet_size_probability(events, average_active=True).orderBy("ts").collect()
    assert [r["size"] for r in active] == pytest.approx([0.0800556, -0.3374794, 0.3117866, 0.9610525, 0.3571025, 0.2130815, 0.6730107, 0], abs=1e-6)
    assert [r["size"] for r in signals.bet_size_budget(events).orderBy("id").collect()] == pytest.approx([1, -1, 0, 0, 0])
    rows = spark.createDataFrame(list(zip((25.0, 35.0, 45.0, 40.0, 30.0), (75.5, 76.9, 74.1, 67.75, 62.0), (80.0, 75.0, 72.5, 65.0, 70.8), strict=True)), "pos double, m double, f double")
    size, target, _ = bet_sizing.bet_size_dynamic(F.col("pos"), F.lit(55.0), F.col("m"), F.col("f"))
    got = rows.select(size.alias("s"), target.alias("t")).collect()
    assert [r["s"] for r in got] == pytest.approx([0.8075296, -0.5004625, -0.4376861, -0.6416933, 0.9367889], abs=1e-6)
    assert [r["t"] for r in got] == [44, -27, -24, -35, 51]


def test_normal_distribution(spark):
    xs = [-9.0, -3.3, -1.0, 0.0, 0.5, 2.7, 7.5]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.norm_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-14)


def test_entropies():
    m = "11100001"
    assert entropy.plug_in(m, 1) == pytest.approx(0.985, abs=1e-3) and entropy.lempel_ziv(m) == 0.625
    assert entropy.kontoyiannis(m, 0) == pytest.approx(0.9682, abs=1e-3)


def test_rolling_goldens():
    assert rolling.Ewma(2)(np.array([1205.0, 1005.0]))[0] == 1205 and len(rolling.fracdiff_weights_ffd(0.9, 1e-3, 100)) == 12
    y = np.random.default_rng(1).normal(size=60)
    w = rolling.fracdiff_weights(0.4, 60)
    assert rolling.frac_diff_values(y, 0.4, 0.99)[-1] == pytest.approx(float(np.dot(w, y)))


def test_splits():
    start = np.arange(10)
    spans = [(np.array([1, 2]), 7), (np.array([8, 11]), 6), (np.array([6, 8]), 5)]
    del spans
    for train, test in validation.purged_kfold(start, start + 2, 5, 0.1):
        for i in train:
            for j in test:
                assert not (start[i] <= start[j] + 2 and start[i] + 2 >= start[j]) and abs(i - j) > 1
    assert validation.cpcv_path_count(6, 2) == 5 and validation.cpcv_path_count(8, 3) == 21
    splits, chosen, paths = validation.cpcv(start, start + 1, 5, 2)
    assert len(splits) == len(chosen) == 10 and len(paths) == 4 and all(g in chosen[s] for p in paths for g, s in p.items())


def test_train_times(spark):
    minute = [at(60 * i) for i in range(14)]
    spans = spark.createDataFrame([(minute[i], minute[i + 2]) for i in range(10)], "start timestamp_ntz, end timestamp_ntz")

    def left(a, b):
        return validation.train_times(spans, spark.createDataFrame([(minute[a], minute[b])], "start timestamp_ntz, end timestamp_ntz")).count()

    assert (left(1, 2), left(8, 11), left(6, 8)) == (7, 6, 5)


def test_portfolio_closed_forms():
    cov = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.16]])
    mu = np.array([0.05, 0.08, 0.12])
    w = portfolio.efficient_risk_weights(cov, mu, 0.09)
    assert w.sum() == pytest.approx(1) and w @ mu == pytest.approx(0.09)
    best = portfolio.max_sharpe_weights(cov, mu, 0.01)
    for other in np.random.default_rng(0).dirichlet(np.ones(3), 200):
        assert (best @ mu - 0.01) / np.sqrt(best @ cov @ best) >= (other @ mu - 0.01) / np.sqrt(other @ cov @ other) - 1e-12
        assert portfolio.min_vol_weights(cov) @ cov @ portfolio.min_vol_weights(cov) <= other @ cov @ other + 1e-12
    hrp, order = portfolio.hrp_weights(cov)
    assert hrp.sum() == pytest.approx(1) and sorted(order) == [0, 1, 2] and (hrp > 0).all()
    for metric in portfolio.HCAA_METRICS:
        w = portfolio.hcaa_weights(cov, mu, np.random.default_rng(1).normal(0, 0.01, (200, 3)), metric)
        assert w.sum() == pytest.approx(1)
    assert portfolio.project(np.array([0.9, 0.2, -0.1]), np.array([[0, 0.5]] * 3)).sum() == pytest.approx(1)
    block = np.kron(np.eye(3), np.full((4, 4), 0.9)) + 0.1 * np.eye(12)
    groups, _ = portfolio.onc_clusters(block, repeat=4)
    assert sorted(map(sorted, groups)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_sadf_equals_plain_regressions():
    y = np.cumsum(np.random.default_rng(2).normal(0, 0.01, 60)) + 4
    for model in breaks.MODELS:
        x, t = breaks.sadf_design(y, model, 2, True)
        got = breaks.sadf_values(x, t, 20)
        for k, end in enumerate(range(20, len(t))):
            best = -np.inf
            for s in range(0, end - 20 + 2):
                a, b = x[s : end + 1], t[s : end + 1]
                if not np.isfinite(a).all() or np.linalg.cond(a.T @ a) > 1e15:
                    continue
                coef, inverse = np.linalg.solve(a.T @ a, a.T @ b), np.linalg.inv(a.T @ a)
                e = b - a @ coef
                best = max(best, coef[0] / np.sqrt(e @ e / (len(b) - a.shape[1]) * inverse[0, 0]))
            assert got[k] == pytest.approx(best, rel=1e-3, abs=1e-3)


def test_distance_correlation_and_bins():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = x**2 + 0.1 * rng.normal(size=300)
    assert dependence.distance_correlation_values(x, y, 64) == pytest.approx(dependence.distance_correlation_values(x, y, 1000))
    assert dependence.distance_correlation_values(x, x) == pytest.approx(1) and dependence.optimal_bins(1000) > 5


def test_strategy_risk_inverts(spark):
    n, win, loss = F.lit(260.0), F.lit(0.005), F.lit(-0.01)
    p = sharpe.implied_precision_symmetric(F.lit(2.0), n)
    q = sharpe.implied_precision_asymmetric(F.lit(1.5), n, win, loss)
    row = spark.range(1).select(
        sharpe.sharpe_symmetric(p, n).alias("a"), sharpe.implied_frequency_symmetric(p, F.lit(2.0)).alias("b"), sharpe.sharpe_asymmetric(q, n, win, loss).alias("c"), sharpe.implied_frequency_asymmetric(q, F.lit(1.5), win, loss).alias("d")
    ).first()
    assert list(row) == pytest.approx([2.0, 260.0, 1.5, 260.0], abs=1e-6)


def test_moments_of_mixtures():
    raw = simulate.raw_moments(-2.0, 1.0, 2.0, 1.0, 0.1)
    central = [simulate.centered_moment(raw, k) for k in range(1, 6)]
    assert simulate.raw_from_central(central, raw[0]) == pytest.approx(raw)
    fits = simulate.fit_moments(raw, epsilon=1e-3, seed=1)
    assert fits and fits[-1][-1] < 1.0


def test_partitions_cover_all_atoms(spark):
    for strategy in ("linear", "nested"):
        parts = simulate.partition_atoms(101, 7, strategy)
        assert [x for a, b in parts for x in range(a, b)] == list(range(101))
    assert sum(simulate.run_parallel(spark, list(range(50)), sum, parts=3, strategy="nested")) == 1225


def test_trading_paths(spark):
    paths = simulate.trading_paths(spark, 3, (-1, 1), (0, 1), terminal=0)
    dear, cheap = (simulate.path_objective([0.01, 0.01, 0.01], ticket=t) for t in (0.002, 0.0))
    row = paths.where("trades = array(1L, -1L, 0L)").select(dear.alias("a"), cheap.alias("b")).first()
    assert row["b"] - row["a"] == pytest.approx(0.004)


def test_etf_trick(spark):
    dates = [f"2020-01-{i:02d}" for i in range(1, 7)]
    rows = [(d, s, 10.0 + i, 10.5 + i, 1.0 if s == "x" else 0.0, 0.0) for i, d in enumerate(dates) for s in ("x", "y")]
    t = spark.createDataFrame(rows, "date string, security string, open double, close double, alloc double, cost double").withColumn("rate", F.lit(1.0))
    got = [r["value"] for r in etf.etf_trick(t).orderBy("date").collect()]
    assert got[0] == 1.0 and len(got) == 4 and got[1] == pytest.approx(1 + 1 / 12.0)


def test_streaming_equals_replay(spark, tmp_path):
    config = early_warning.WarningConfig(500.0, 10, 40, 0.3, 0.2)
    events = early_warning.synthetic_crash(spark, 600).withColumn("stream", F.concat(F.lit("s"), (F.col("ord") % 3).cast("string")))
    source = str(tmp_path / "in")
    for k in range(3):  # three files, in order of arrival
        events.where(F.floor(F.col("ord") / 200) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = early_warning.watch(stream, config).writeStream.format("memory").queryName("warnings").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r["stream"], r["ord"]): r for r in early_warning.replay(events, config).collect()}
    got = {(r["stream"], r["ord"]): r for r in spark.table("warnings").collect()}
    assert set(batch) == set(got)
    order = {k: got[k]["alert"] == batch[k]["alert"] for k in got}
    assert sum(order.values()) >= 0.95 * len(order)
    calm, shock = (batch[("s0", i)] for i in (399, 597))
    assert shock["vpin"] > calm["vpin"] and shock["hhi"] > calm["hhi"] and any(r["alert"] for r in batch.values())


def test_pipeline_contract(spark):
    close, prob, side = (100, 100.2, 99.9, 100.4, 100, 100.7, 100.4, 100.9), (0.55, 0.60, 0.52, 0.48, 0.61, 0.58, 0.63, 0.57), (1, 1, -1, 1, 1, -1, 1, 1)
    rows = spark.createDataFrame([("A", at(60 * i), i, float(c), p, float(s)) for i, (c, p, s) in enumerate(zip(close, prob, side, strict=True))], "symbol string, ts timestamp_ntz, ord int, close double, prob double, side double")
    rng = np.random.default_rng(0)
    prices = spark.createDataFrame([(at(60 * i), a, float(100 + rng.normal())) for i in range(8) for a in "xyz"], "ts timestamp_ntz, asset string, price double")
    out = pipeline.run_pipeline(rows, prices, pipeline.PipelineConfig(cusum_threshold=0.0005))
    assert out.path.count() == 8 and out.path.where("ret is null").count() == 1 and out.portfolio.weights.sum() == pytest.approx(1)
    leak = out.leakage.first()
    assert leak["inputs_aligned"] and leak["event_indices_sorted"] and not leak["has_forward_look_bias"]
    by_hand, held = [], 0.0
    signal = {r["ord"]: r["signal"] for r in out.signals.collect()}
    for i in range(8):
        if i:
            by_hand.append(held * (close[i] / close[i - 1] - 1))
        held = signal.get(i, held)
    assert [r["ret"] for r in out.path.orderBy("ord").collect()][1:] == pytest.approx(by_hand)


def test_experiment(spark, tmp_path):
    text = '[run]\nname = "demo"\n[dataset]\nn_bars = 64\n[pipeline]\ncusum_threshold = 0.001\n'
    folder = experiment.run_experiment(spark, text, str(tmp_path))
    assert spark.read.parquet(f"{folder}/metrics.parquet").count() == 1 and open(f"{folder}/decision.md").read().startswith("# demo")
    board = experiment.run_experiment_grid(spark, text, '[[runs]]\nname = "a"\n[[runs]]\nname = "b"\nstep_size = 0.2\n', str(tmp_path))
    assert spark.read.parquet(board).count() == 2


def test_frames_and_payloads(spark):
    assert frames.weights_frame(spark, ["a"], [1.0], "2024-01-01").columns == ["asset", "weight", "as_of"]
    with pytest.raises(ValueError):
        frames.signal_frame(spark, [T0], [1.0, 2.0])
    buffer = frames.SignalBuffer()
    buffer.append(frames.signal_frame(spark, [T0], [1.0]))
    buffer.append(frames.signal_frame(spark, [T0], [1.0], symbol="A"))
    assert buffer.frame().count() == 2
    top = frames.importance_payload(spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double"), 1)
    assert top["x"] == ["b"] and frames.regime_payload([1, 2], [-1.0, 1.0])["regime"] == [-1, 1]


def test_ensembles(spark):
    p = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 1), (0, 1, 1), (1, 1, 1), (2, 1, 0), (0, 2, 0), (1, 2, 1), (2, 2, 1)], "sample int, model int, value int")
    assert [r["label"] for r in learning.classification_vote(p).orderBy("sample").collect()] == [1, 1, 1]
    assert learning.kendall(np.array([1.0, 2, 3]), np.array([3.0, 2, 1])) == -1.0
