"""Operators whose queries have no SQL, against NumPy or by the conditions that define their result."""

from __future__ import annotations

import time

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from loomquant import catalog
from loomquant.functions.bet_sizing import aligned
from loomquant.operators import ensembles, portfolio, signals, simulate, validation
from loomquant.plans import frames
from loomquant.sources import ohlcv
from loomquant.streaming import early_warning

QUERIES = catalog.queries()


def table(spark, n=60, seed=2):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, 2)), rng.uniform(0.5, 2, n)
    y = (x[:, 0] + rng.normal(0, 0.7, n) > 0).astype(float)
    rows = [(i, [float(a) for a in x[i]], float(y[i]), float(w[i])) for i in range(n)]
    spans = spark.createDataFrame([(i, i % 20, i % 20 + 1 + i % 4) for i in range(n)], "id long, start long, end long")
    return spark.createDataFrame(rows, "id long, x array<double>, y double, weight double"), spans, x, y, w


def test_sequential_bagging_equals_its_twin(spark):
    rows, spans, x, y, w = table(spark)
    model = ensembles.SequentialBagging(estimators=7, max_samples=0.5, max_features=0.5, seed=3).fit(rows, spans)
    bags = model.bags.toPandas()
    assert bags.groupby("estimator").size().tolist() == [30] * 7
    features = [s[0] for s in ensembles.feature_subsets(2, 7, 0.5, seed=3)]
    votes, outside = np.zeros((7, 60)), np.ones((7, 60), dtype=bool)
    for e, at in bags.groupby("estimator")["id"]:
        at = at.to_numpy()
        f = x[:, features[e]]
        cut = np.average(f[at], weights=w[at])
        rate = [np.average(y[at][m], weights=w[at][m]) if m.any() else 0.0 for m in (f[at] >= cut, f[at] < cut)]
        votes[e] = (f >= cut) == (rate[0] >= rate[1])
        outside[e, at] = False
    got = {r["id"]: r["value"] for r in model.predict(rows).collect()}
    assert all(got[i] == (2 * votes[:, i].sum() >= 7) for i in range(60))
    score = model.oob(rows).first()
    said = [i for i in range(60) if outside[:, i].any()]
    right = [(2 * votes[outside[:, i], i].sum() >= outside[:, i].sum()) == y[i] for i in said]
    assert score["rows"] == len(said) and score["score"] == pytest.approx(np.mean(right))


def test_bagging_regressor_and_warm_start(spark):
    rows, spans, x, y, w = table(spark)
    model = ensembles.SequentialBagging("regressor", estimators=3, warm_start=True, seed=1).fit(rows, spans)
    first = model.models.orderBy("estimator").collect()
    model.estimators = 5
    model.fit(rows, spans)
    kept = model.models.orderBy("estimator").collect()
    assert len(kept) == 5 and all(tuple(a) == pytest.approx(tuple(b)) for a, b in zip(kept, first, strict=False))
    one = first[0]
    at = model.bags.where("estimator = 0").toPandas()["id"].to_numpy()
    slope, intercept = np.polyfit(x[at, one["feature"]], y[at], 1, w=np.sqrt(w[at]))
    assert (one["slope"], one["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    for bad in (dict(max_samples=0.0), dict(max_samples=61), dict(max_features=3), dict(estimators=0), dict(kind="tree")):
        with pytest.raises(ValueError):
            ensembles.SequentialBagging(**bad).fit(rows, spans)
    with pytest.raises(ValueError):
        model.oob(rows)  # after a warm start
    model.estimators = 2
    with pytest.raises(ValueError):
        model.fit(rows, spans)


def test_sequential_bagging_query(spark):
    got = QUERIES["bagging__sequential"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert {r["value"] for r in got.select("value").distinct().collect()} <= {0.0, 1.0}


def test_turning_points_are_optimal():
    """A frontier point is optimal if the gradient of lambda * mean - variance / 2 is equal over free assets, not greater at
    lower bounds and not less at upper ones."""
    rng = np.random.default_rng(8)
    for trial in range(25):
        n = int(rng.integers(2, 8))
        a = rng.normal(size=(3 * n, n))
        cov, mu = a.T @ a / (3 * n), rng.normal(0.05, 0.1, n)
        bounds = np.stack([rng.uniform(0, 0.5 / n, n), rng.uniform(1.2 / n, 1.0, n)], axis=1) if trial % 2 else np.tile((0.0, 1.0), (n, 1))
        points = portfolio.critical_line(mu, cov, bounds)
        assert points[-1].tolerance == 0.0
        for p in points[1:]:
            w, gradient = p.weights, p.tolerance * mu - cov @ p.weights
            assert w.sum() == pytest.approx(1) and (w >= bounds[:, 0] - 1e-9).all() and (w <= bounds[:, 1] + 1e-9).all()
            inside = (w > bounds[:, 0] + 1e-7) & (w < bounds[:, 1] - 1e-7)
            if inside.any():
                level = gradient[inside].mean()
                assert gradient[inside] == pytest.approx(level, abs=1e-7)
                assert (gradient[w <= bounds[:, 0] + 1e-7] <= level + 1e-7).all()
                assert (gradient[w >= bounds[:, 1] - 1e-7] >= level - 1e-7).all()
        least = portfolio.min_variance_bounded(cov, bounds, mu)
        for _ in range(200):  # no feasible portfolio has less variance
            w = portfolio.project(rng.dirichlet(np.ones(n)), bounds)
            if (w >= bounds[:, 0] - 1e-12).all() and (w <= bounds[:, 1] + 1e-12).all():
                assert least @ cov @ least <= w @ cov @ w + 1e-12
    with pytest.raises(ValueError):
        portfolio.critical_line(np.ones(2), np.eye(2), np.tile((0.0, 0.3), (2, 1)))


def test_critical_line_query(spark):
    got = QUERIES["portfolio__critical_line"](spark, DATA).toPandas()
    assert got.groupby("point")["weight"].sum().tolist() == pytest.approx([1.0] * got["point"].nunique())
    assert got["weight"].between(0.05 - 1e-9, 0.6 + 1e-9).all()


def test_cross_validation_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3))
    y = (x[:, 0] > 0).astype(float)
    splits = validation.purged_kfold(np.arange(90), np.arange(90) + 1, 5)
    got = validation.cross_val_scores(spark, validation.LinearProbability, x, y, splits, "accuracy").orderBy("split").collect()
    for r, (train, test) in zip(got, splits, strict=True):
        model = validation.LinearProbability().fit(x[train], y[train])
        assert r["score"] == pytest.approx(validation.score(y[test], model.predict_proba(x[test]), "accuracy"))


def test_walk_forward_ends_with_a_shorter_window():
    splits = validation.walk_forward(np.arange(25), np.arange(25), 10, 6, 5)
    assert [t.tolist() for _, t in splits] == [list(range(b, min(b + 6, 25))) for b in (10, 15, 20)]
    with pytest.raises(ValueError):
        validation.walk_forward(np.arange(5), np.arange(5) + 9, 2, 2, 1)


def test_trading_rule_workflow(spark):
    rng = np.random.default_rng(1)
    price = [50.0]
    for _ in range(400):
        price.append(10 + 0.8 * price[-1] + rng.normal(0, 1))
    rows = spark.createDataFrame([("A", i, p) for i, p in enumerate(price)], "symbol string, ts long, price double")
    params, surface, best, flat = simulate.otr_workflow(rows, n_paths=40, horizon=30, profit=[1.0, 2.0], stop=[1.0, 3.0], max_holding=25)
    phi, intercept = np.polyfit(price[:-1], price[1:], 1)
    assert params.phi == pytest.approx(phi) and params.equilibrium == pytest.approx(intercept / (1 - phi))
    top = surface.toPandas()
    assert len(top) == 4 and best.first()["sharpe"] == pytest.approx(top["sharpe"].max())
    assert flat.first()["gap"] == pytest.approx(top["sharpe"].max() - top["sharpe"].median())
    with pytest.raises(ValueError):
        simulate.otr_workflow(rows.unionAll(rows.withColumn("symbol", F.lit("B"))), n_paths=1, horizon=2, profit=[1.0], stop=[1.0], max_holding=1)
    assert QUERIES["synthetic__otr_workflow"](spark, DATA).count() == 9


def test_dispatched_run(spark):
    handle = simulate.dispatch(spark, list(range(100)), sum, parts=4)
    assert sum(handle.wait(120)) == 4950 and handle.is_finished()
    failing = simulate.dispatch(spark, [1, 2], lambda part: 1 / 0, parts=2)
    with pytest.raises(Exception, match="ZeroDivision"):
        failing.wait(120)


def test_mixture_of_two_normals():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(-3, 1, 4000), rng.normal(4, 2, 6000)])
    fit = signals.fit_two_normals(values, np.ones(len(values)), runs=5)
    assert fit == pytest.approx((-3, 4, 1, 2, 0.4), abs=0.1)


def test_load_ohlcv_with_report(spark, tmp_path):
    lines = ["Date,Open,High,Low,Close,Volume"] + [f"2024-01-0{d},1,2,0.5,{c},10" for d, c in ((1, 1), (1, 3), (2, 2), (4, 2), (5, "x"))]
    (tmp_path / "bars.csv").write_text("\n".join(lines))
    bars, report = ohlcv.load_ohlcv(spark, f"file://{tmp_path}/bars.csv", symbol="A", report=True)
    got = {str(r["ts"])[:10]: r["close"] for r in bars.collect()}
    assert got == {"2024-01-01": 3.0, "2024-01-02": 2.0, "2024-01-04": 2.0}  # the later row of a key stays
    r = report.first()
    assert (r["row_count"], r["duplicate_key_count"], r["rows_removed_by_deduplication"], r["gap_interval_count"]) == (3, 0, 1, 1)
    bars.write.parquet(f"{tmp_path}/bars.parquet")
    assert ohlcv.load_ohlcv(spark, f"{tmp_path}/bars.parquet").count() == 3
    with pytest.raises(ValueError):
        ohlcv.load_ohlcv(spark, f"{tmp_path}/bars.txt")


def test_draws_do_not_follow_partitions(spark):
    rows = spark.createDataFrame([("A", float(v)) for v in np.random.default_rng(1).normal(0.1, 1, 300)], "symbol string, ret double")
    one, two = (signals.strategy_failure(rows.repartition(n), target_sharpe=1.0, years=1.0).first() for n in (1, 5))
    assert one["empirical"] == two["empirical"] and one["smoothed"] == pytest.approx(two["smoothed"])


def test_small_helpers(spark, tmp_path):
    assert aligned(pos=[1, 2], f=3) == [{"pos": 1.0, "f": 3.0}, {"pos": 2.0, "f": 3.0}]
    for bad in (dict(a=[1, 2], b=[1, 2, 3]), dict(a=[], b=1)):
        with pytest.raises(ValueError):
            aligned(**bad)
    state = early_warning.WarningState(early_warning.WarningConfig(bucket_volume=10.0, support_buckets=2, vpin_threshold=0.5, lookback_events=3, hhi_threshold=0.5))
    for k in range(5):
        state.on_event(6.0, 2.0, k % 2)
    assert (state.completed_buckets, state.window_length) == (2, 3)
    importance = spark.createDataFrame([("b", 0.3, 0.1), ("a", 0.7, 0.2)], "feature string, mean double, std_error double")
    frames.write_importance(importance, f"{tmp_path}/importance", oob=0.6, oos=0.5)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/importance").collect()] == [("0.6", "0.5", "a", "0.7", "0.2"), ("0.6", "0.5", "b", "0.3", "0.1")]
    assert frames.effect_lines(importance) == ["a: mean 0.7, std_error 0.2", "b: mean 0.3, std_error 0.1"]
    assert frames.frontier_payload([1], [2]) == {"chart": "scatter", "x": [1], "y": [2], "x_label": "volatility", "y_label": "return"}
    assert frames.frontier_payload([1], [2], [3])["color_label"] == "sharpe"
    assert frames.cluster_payload([1], [0]) == {"chart": "tree", "node_id": [1], "parent_id": [0]}
    with pytest.raises(ValueError):
        frames.regime_payload([1, 2], [1.0])


def test_importance_of_folds_equals_models_on_arrays(spark):
    from loomquant.operators import importance

    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(0, 0.5, 80) > 0).astype(float)
    fold = np.arange(80) % 3
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), int(fold[i])) for i in range(80)], "id long, a double, b double, c double, y double, fold int")
    for scoring in ("neg_log_loss", "accuracy"):
        alone, lost = {n: [] for n in "abc"}, {n: [] for n in "abc"}
        for f in range(3):
            train, test = fold != f, np.flatnonzero(fold == f)
            whole = validation.LinearProbability().fit(x[train], y[train])
            base = validation.score(y[test], whole.predict_proba(x[test]), scoring)
            for j, n in enumerate("abc"):
                one = validation.LinearProbability().fit(x[train][:, [j]], y[train])
                alone[n].append(validation.score(y[test], one.predict_proba(x[test][:, [j]]), scoring))
                turned = x[test].copy()
                turned[:, j] = np.roll(turned[:, j], 1)
                s = validation.score(y[test], whole.predict_proba(turned), scoring)
                lost[n].append((base - s) / (-s if scoring == "neg_log_loss" else 1 - s))
        for got, want in (
            (importance.single_feature_scores(rows, ["a", "b", "c"], "y", "fold", scoring=scoring), alone),
            (importance.decrease_in_accuracy(rows, ["a", "b", "c"], "y", "fold", key="id", scoring=scoring), lost),
        ):
            for r in got.collect():
                assert (r["mean"], r["std_error"]) == (pytest.approx(np.mean(want[r["feature"]])), pytest.approx(np.std(want[r["feature"]]) / np.sqrt(3)))
    with pytest.raises(ValueError):
        importance.fold_grams(rows.where("fold = 0"), ["a"], "y", "fold")


def test_tick_file_to_features(spark, tmp_path):
    from loomquant.operators import entropy
    from loomquant.sources.ticks import load_ticks

    rng = np.random.default_rng(3)
    price, volume = np.round(100 + rng.normal(0, 1, 90).cumsum(), 1), rng.integers(1, 20, 90)
    lines = ["when,px,size"] + [f"2024-03-01 10:{i // 60:02d}:{i % 60:02d},{p},{v}" for i, (p, v) in enumerate(zip(price, volume, strict=True))]
    (tmp_path / "ticks.csv").write_text("\n".join(lines))
    ticks = load_ticks(spark, f"file://{tmp_path}/ticks.csv", symbol="A")
    marks = spark.createDataFrame([("A", 39), ("A", 79)], "symbol string, last long")
    codes = entropy.quantile_codes(ticks, "volume", 5)
    got = {r["bar_end"]: r for r in entropy.tick_features(ticks, marks, volume_codes=codes).collect()}
    assert set(got) == {39, 79}  # ticks after the last boundary are in no bar
    sign, signs = 0.0, []
    for d in np.diff(price, prepend=price[0]):
        sign = np.sign(d) or sign
        signs.append(sign)
    signs, diff = np.array(signs), np.diff(price, prepend=price[0])
    log_ret = np.diff(np.log(price), prepend=np.log(price[0]))
    for a, b in ((0, 40), (40, 80)):
        r, s, v, dv, lr = got[b - 1], signs[a:b], volume[a:b], price[a:b] * volume[a:b], np.abs(log_ret[a:b])
        assert r["kyle"] == pytest.approx((v * s * diff[a:b]).sum() / ((v * s) ** 2).sum())
        assert r["amihud"] == pytest.approx((dv * lr).sum() / (dv**2).sum())
        assert r["hasbrouck"] == pytest.approx((np.sqrt(dv) * s * lr).sum() / ((np.sqrt(dv) * s) ** 2).sum())
        messages = {"tick": "".join({1: "a", -1: "b"}.get(x, "c") for x in s)}
        messages["volume"] = "".join(min(((abs(x - k), i, c) for i, (k, c) in enumerate(codes)))[2] for x in v)
        for kind, m in messages.items():
            for name, f in entropy.ENTROPIES.items():
                assert r[f"{kind}_{name}"] == pytest.approx(f(m)), (kind, name)
    (tmp_path / "bad.csv").write_text("a,b,c\n2024-01-01 00:00:00,x,1\n")
    with pytest.raises(Exception, match="not a price"):
        load_ticks(spark, f"file://{tmp_path}/bad.csv").collect()
    (tmp_path / "two.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        load_ticks(spark, f"file://{tmp_path}/two.csv")


def test_invalid_events_are_left_out_or_errors(spark):
    rows = [("s", 0, 1.0, 2.0, 1.0, 1), ("s", 1, -1.0, 2.0, 1.0, 1), ("s", 2, 1.0, 0.0, 0.0, 1), ("s", 3, 1.0, None, 1.0, 1)]
    events = spark.createDataFrame(rows, "stream string, ord long, price double, buy_volume double, sell_volume double, venue long")
    config = early_warning.WarningConfig()
    assert [r["ord"] for r in early_warning.replay(events, config).collect()] == [0]
    with pytest.raises(Exception, match="invalid event"):
        early_warning.replay(events, config, strict=True).collect()
