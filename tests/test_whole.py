"""Queries over whole tables, on rows beyond those of the small test tables: against their SQL or brute force."""

from __future__ import annotations

import numpy as np
import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from loomquant import catalog
from loomquant.operators import breaks, dependence, entropy, weights

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="session")
def orders_beyond(spark, tmp_path_factory):
    """Orders with keys on both sides of 2000, and the same as a DuckDB view."""
    import duckdb

    where = str(tmp_path_factory.mktemp("orders"))
    more = spark.read.parquet(f"{DATA}/orders.parquet")
    more = more.unionByName(more.withColumn("o_orderkey", F.col("o_orderkey") + 1500))
    more.coalesce(1).write.mode("overwrite").parquet(f"{where}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{where}/orders.parquet/*.parquet'")
    return where, con


@pytest.mark.parametrize("name", ["sampling__indicator", "sampling__label_uniqueness", "sampling__average_uniqueness", "sampling__bootstrap_step"])
def test_spans_of_all_orders(name, spark, orders_beyond):
    where, con = orders_beyond
    assert_same(QUERIES[name](spark, where).toPandas(), con.sql(ORACLES[name]).df())


def test_sequential_bootstrap_draws_from_all_orders(spark, orders_beyond):
    rows = QUERIES["sampling__sequential_bootstrap"](spark, orders_beyond[0]).toPandas()
    assert len(rows) == 4 * 3000 and rows["id"].max() > 2000


def test_sequential_draws_follow_average_uniqueness():
    starts, ends = np.array([0, 2, 2, 7]), np.array([2, 3, 8, 7])
    n = 20_000
    rng = np.random.default_rng(1)
    second = np.bincount([weights.sequential_draws(starts, ends, 9, 2, rng, [1])[1] for _ in range(n)], minlength=4) / n
    c = np.ones(9)
    c[2:4] += 1
    average = np.array([np.mean(1 / c[s : e + 1]) for s, e in zip(starts, ends, strict=True)])
    assert second == pytest.approx(average / average.sum(), abs=0.015)


@pytest.fixture(scope="session")
def later_orders(tmp_path_factory):
    """Daily orders of one symbol over the years around the dates in the SQL."""
    import duckdb

    where = str(tmp_path_factory.mktemp("later"))
    con = duckdb.connect()
    con.execute("""CREATE TABLE orders AS SELECT i AS o_orderkey, 'A' AS o_orderpriority, TIMESTAMP '1995-06-01' + to_days(CAST(i AS INT)) AS o_orderdate,
      1000 + 40 * i + 900 * sin(i * i) AS o_totalprice FROM range(400) t(i)""")
    con.execute(f"COPY orders TO '{where}/orders.parquet' (FORMAT parquet)")
    return where, con


@pytest.mark.parametrize("name", ["breaks__chow", "breaks__csw_one_sided", "breaks__csw_two_sided", "breaks__sadf_sm_exp"])
def test_breaks_of_the_whole_series(name, spark, later_orders):
    where, con = later_orders
    got = QUERIES[name](spark, where).toPandas()
    want = con.sql(ORACLES[name]).df()
    key = "break" if "break" in got else "i"
    both = got.merge(want, on=["symbol", key], how="outer", suffixes=("", "_sql"))
    assert len(both) == len(got) == len(want) > 340
    for c in set(got) - {"symbol", key}:  # sums in another order
        assert both[c].to_numpy() == pytest.approx(both[f"{c}_sql"].to_numpy(), abs=2e-3 if "sadf" in c else 2e-5)


@pytest.mark.parametrize("model", breaks.MODELS)
def test_sadf_of_the_whole_series(model, spark, later_orders):
    where, con = later_orders
    got = QUERIES[f"breaks__sadf_{model}"](spark, where).orderBy("i").toPandas()["sadf"].to_numpy()
    y = np.log(con.sql("SELECT o_totalprice AS p FROM orders ORDER BY o_orderdate").df()["p"].to_numpy())
    x, t = breaks.sadf_design(y, model, 2, True)
    assert len(got) == len(t) - 30
    for end in (30, 31, 200, len(t) - 1):
        best = -np.inf
        for s in range(end - 30 + 2):
            a = x[s : end + 1]
            if np.isfinite(a).all():
                scale = np.linalg.norm(a, axis=0)
                q, r = np.linalg.qr(a / scale)
                coef, inverse = np.linalg.solve(r, q.T @ t[s : end + 1]), np.linalg.inv(r)
                e = t[s : end + 1] - a / scale @ coef
                best = max(best, coef[0] / np.sqrt(e @ e / (len(e) - a.shape[1]) * (inverse[0] @ inverse[0])))
        assert got[end - 30] == pytest.approx(best, abs=2e-3)


@pytest.fixture(scope="session")
def many_events(tmp_path_factory):
    """2,350 ticks of one symbol and 130 of another, a few minutes apart."""
    import duckdb

    where = str(tmp_path_factory.mktemp("ticks"))
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, CASE WHEN i < 2350 THEN 'A' ELSE 'B' END AS event_type, TIMESTAMP '2024-01-01' + to_minutes(CAST(20 * i AS BIGINT)) AS ts,
      round(200 + 150 * sin(i * i), 2) AS value, CAST(i * 31 % 97 AS BIGINT) AS user_id FROM range(2480) t(i)""")
    con.execute(f"COPY events TO '{where}/events.parquet' (FORMAT parquet)")
    return where, con


def test_bar_features_of_all_ticks(spark, many_events):
    where, con = many_events
    assert_same(QUERIES["entropy__bar_features"](spark, where).toPandas(), con.sql(ORACLES["entropy__bar_features"]).df())


def test_sequential_entropies_of_whole_messages(spark, many_events):
    where, _ = many_events
    messages = QUERIES["entropy__messages"](spark, where).toPandas().set_index("symbol")["message"]
    got = QUERIES["entropy__sequential"](spark, where).toPandas().set_index("symbol")
    assert len(messages["A"]) == 2350
    for symbol, m in messages.items():
        terms = [np.log2(i + 1) / entropy.match_length(m, i, i) for i in range(1, len(m) // 2 + 1)]
        assert got.loc[symbol, "kontoyiannis"] == pytest.approx(np.mean(terms), abs=1e-6)
        assert got.loc[symbol, "kontoyiannis_window"] == pytest.approx(entropy.kontoyiannis(m, 20), abs=1e-6)
        assert got.loc[symbol, "lempel_ziv"] == pytest.approx(entropy.lempel_ziv(m), abs=1e-6)


def test_earlier_matches_equal_brute_force():
    rng = np.random.default_rng(4)
    for m in ["a", "ab", "aaaaaaa", "abababab", *("".join(rng.choice(list("abc"[:k]), n)) for k in (1, 2, 3) for n in (5, 40, 120))]:
        got = entropy.earlier_matches(m)
        for i in range(len(m)):
            assert got[i] == max((s for s in range(len(m) - i + 1) if s == 0 or 0 <= m.find(m[i : i + s], 0, i + s - 1) < i), default=0)


def test_distance_correlation_of_all_ticks(spark, many_events):
    where, con = many_events
    got = QUERIES["codependence__distance_correlation"](spark, where).toPandas().set_index("symbol")["distance_correlation"]
    for symbol, t in con.sql("SELECT event_type AS symbol, value AS x, user_id % 10 + 1 AS y FROM events").df().groupby("symbol"):
        x, y = (t[c].to_numpy().astype(float) for c in "xy")
        assert got[symbol] == pytest.approx(dependence.distance_correlation_values(x, y), abs=1e-6)


def test_fast_distance_correlation_equals_the_matrices():
    rng = np.random.default_rng(5)
    for n in (2, 3, 7, 64, 301):
        x = rng.integers(0, 9, n).astype(float)  # with ties
        for y in (rng.normal(1e3, 1, n), x**2, rng.integers(0, 3, n).astype(float)):
            assert dependence.fast_distance_correlation(x, y) == pytest.approx(dependence.distance_correlation_values(x, y), abs=1e-5, nan_ok=True)


@pytest.mark.parametrize("name", ["labeling__vertical_barrier", "labeling__triple_barrier_events", "labeling__triple_barrier_labels", "labeling__meta_labels"])
def test_labels_of_all_ticks(name, spark, duck):
    assert_same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df())


def test_indicator_frame_of_all_events(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, i AS user_id FROM range(1, 21) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert_same(QUERIES["frames__indicator"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["frames__indicator"]).df())
