"""Ensembles scored out of bag, backtests as runs, bars over OHLCV rows, histograms and the critical line."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bars, dependence, ensembles, entropy, importance, portfolio, simulate, validation
from ..sources import domain, ohlcv
from .base import TICKS, Catalog, r, rounded
from .market import BAR_SQL, CLEAN, NUMBERED, RAW, raw_ohlcv, sum_bars_sql, told
from .statistics import FEAT, features

C = Catalog()

# Bagging: which rows an estimator draws is a rule, so that SQL can follow it

N_ESTIMATORS = 5
SUBSETS = [e % 2 for e in range(N_ESTIMATORS)]
ROWS = """r AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(min(l_quantity) AS DOUBLE) AS x0, min(l_extendedprice) / 1000e0 AS x1, CAST(max(l_returnflag) = 'R' AS DOUBLE) AS lab,
  min(l_extendedprice) / 2000e0 + max(l_tax) * 100 AS z, 1e0 + max(l_linenumber) % 3 AS w FROM lineitem GROUP BY 1),
e AS (SELECT CAST(i AS INT) AS e FROM range(5) t(i)),
b AS (SELECT e, id, CASE WHEN e % 2 = 0 THEN x0 ELSE x1 END AS x, lab, z, w FROM r, e WHERE (id * 7 + e * 13) % 5 < 3)"""
STUMPS = f"""{ROWS}, c AS (SELECT e, sum(x * w) / sum(w) AS cut FROM b GROUP BY e),
m AS (SELECT e, cut, coalesce(sum(w * lab) FILTER (x >= cut) / sum(w) FILTER (x >= cut), 0) >= coalesce(sum(w * lab) FILTER (x < cut) / sum(w) FILTER (x < cut), 0) AS above FROM b JOIN c USING (e) GROUP BY e, cut),
o AS (SELECT id, any_value(lab) AS y, sum(CAST(CASE WHEN CASE WHEN e % 2 = 0 THEN x0 ELSE x1 END >= cut THEN above ELSE NOT above END AS DOUBLE)) AS v, count(*) AS n FROM r JOIN m ON (id * 7 + e * 13) % 5 >= 3 GROUP BY id),
found AS (SELECT id, y, CAST(2 * v >= n AS DOUBLE) AS value, CAST(n AS INT) AS n FROM o)"""
LINES = f"""{ROWS}, s AS (SELECT e, sum(w) AS w, sum(w * x) AS wx, sum(w * z) AS wz, sum(w * x * x) AS wxx, sum(w * x * z) AS wxz FROM b GROUP BY e),
l AS (SELECT e, (wxz - wx * wz / w) / (wxx - wx * wx / w) AS slope, wx, wz, w FROM s),
o AS (SELECT id, any_value(z) AS y, avg((wz - slope * wx) / l.w + slope * CASE WHEN e % 2 = 0 THEN x0 ELSE x1 END) AS value, count(*) AS n FROM r JOIN l ON (id * 7 + e * 13) % 5 >= 3 GROUP BY id),
found AS (SELECT id, y, value, CAST(n AS INT) AS n FROM o)"""


def bagged(spark, d, kind: str):
    """Rows, bags, models and what the models say out of bag."""
    li = domain.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_quantity").cast("double").alias("q"), F.min("l_extendedprice").alias("p"), F.max("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"), F.max("l_linenumber").alias("line")
    )
    y = (F.col("flag") == "R").cast("double") if kind == "classifier" else F.col("p") / 2000.0 + F.col("tax") * 100
    rows = li.select("id", F.array(F.col("q"), F.col("p") / 1000.0).alias("x"), y.alias("y"), (1.0 + F.col("line") % 3).alias("weight"))
    every = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(N_ESTIMATORS - 1))).alias("estimator"))
    bags = every.where((F.col("id") * 7 + F.col("estimator") * 13) % 5 < 3).select("estimator", "id")
    models = (ensembles.fit_stumps if kind == "classifier" else ensembles.fit_lines)(bags, rows, SUBSETS)
    return ensembles.out_of_bag(models, bags, rows, kind)


@C.add("bagging__oob_votes", f"WITH {STUMPS} SELECT id, y, value, n FROM found")
def oob_votes(spark, d):
    return bagged(spark, d, "classifier")


@C.add("bagging__oob_lines", f"WITH {LINES} SELECT id, {r('y')} AS y, {r('value')} AS value, n FROM found")
def oob_lines(spark, d):
    return rounded(bagged(spark, d, "regressor"), "y", "value")


@C.add(
    "bagging__oob_scores",
    f"""SELECT 'classifier' AS kind, (SELECT count(DISTINCT l_orderkey * 8 + l_linenumber) FROM lineitem) AS rows, {r(f'(WITH {STUMPS} SELECT avg(CAST(value = y AS DOUBLE)) FROM found)')} AS score
UNION ALL SELECT 'regressor', (SELECT count(DISTINCT l_orderkey * 8 + l_linenumber) FROM lineitem), {r(f'(WITH {LINES} SELECT 1 - sum(pow(y - value, 2)) / sum(pow(y - m, 2)) FROM found, (SELECT avg(y) AS m FROM found))')}""",
)
def oob_scores(spark, d):
    out = None
    for kind in ensembles.KINDS:
        one = ensembles.oob_score(bagged(spark, d, kind), kind).select(F.lit(kind).alias("kind"), "rows", "score")
        out = one if out is None else out.unionAll(one)
    return rounded(out, "score")


@C.add("bagging__sequential")
def sequential(spark, d):
    """Bags drawn by uniqueness over the spans of all orders; tested against a NumPy twin."""
    o = domain.read(spark, d, "orders")
    low = (F.col("o_orderkey") * 3 % 2500).alias("start")
    spans = o.select(F.col("o_orderkey").alias("id"), low, (F.col("o_orderkey") * 3 % 2500 + F.col("o_custkey") % 20).alias("end"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 1000.0, (F.col("o_custkey") % 50).cast("double")).alias("x"), (F.col("o_totalprice") > 200_000).cast("double").alias("y"))
    model = ensembles.SequentialBagging(estimators=6, max_samples=0.3, max_features=1, seed=5).fit(rows, spans)
    return model.predict(rows)


# Backtests over the mean price of each day

DAILY = """d AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS p FROM orders GROUP BY 1), q AS (SELECT row_number() OVER (ORDER BY ts) - 2 AS i, ln(p / lag(p) OVER (ORDER BY ts)) AS ret FROM d),
s AS (SELECT i, ret, i AS a, i + 3 + i % 5 AS b, (SELECT count(*) - 1 FROM q) AS n FROM q WHERE i >= 0)"""
CLASH = "(abs(t.i - s.i) <= CAST(ceil(0.01 * s.n) AS BIGINT) OR (s.a <= t.b AND s.b >= t.a))"
NOTES = {k: "stated" for k in validation.SAFEGUARDS}


def fold_sql(k: int) -> str:
    long = f"((n // {k} + 1) * (n % {k}))"
    return f"CAST(CASE WHEN i < {long} THEN i // (n // {k} + 1) ELSE n % {k} + (i - {long}) // (n // {k}) END AS INT)"


SUMMARY = f"""count(*) AS n, {r('avg(ret)')} AS mean, {r('coalesce(stddev_samp(ret), 0)')} AS std, {r('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(*)), 0)')} AS sharpe"""


def daily(spark, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Returns and label spans of the days: a row for each date of the table, which is few."""
    p = domain.read(spark, d, "orders").groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("p")).orderBy("o_orderdate")
    price = np.array([x["p"] for x in p.collect()])
    start = np.arange(len(price) - 1)
    return np.diff(np.log(price)), start, start + 3 + start % 5


def above_trained_mean(returns: np.ndarray):
    return lambda train, test: returns[test] - returns[train].mean()


def told_runs(df):
    return rounded(df, "mean", "std", "sharpe")


@C.add(
    "backtest__cross_validation_run",
    f"""WITH {DAILY}, f AS (SELECT *, {fold_sql(6)} AS fold FROM s), k AS (SELECT DISTINCT fold AS split FROM f),
tr AS (SELECT split, s.ret FROM k, f s WHERE s.fold <> split AND NOT EXISTS (SELECT 1 FROM f t WHERE t.fold = k.split AND {CLASH})),
m AS (SELECT split, avg(ret) AS m, count(*) AS trained FROM tr GROUP BY 1), x AS (SELECT split, trained, ret - m AS ret FROM f JOIN m ON fold = split)
SELECT split, trained, {SUMMARY} FROM x GROUP BY 1, 2""",
)
def cross_validation_run(spark, d):
    returns, start, end = daily(spark, d)
    return told_runs(validation.run_cross_validation(spark, start, end, above_trained_mean(returns), NOTES, folds=6, pct_embargo=0.01))


@C.add(
    "backtest__walk_forward_run",
    f"""WITH {DAILY}, k AS (SELECT CAST((g - 300) // 250 AS INT) AS split, g AS b0, g + 200 AS b1 FROM range(300, (SELECT any_value(n) FROM s), 250) t(g)),
tr AS (SELECT split, s.ret FROM k, s WHERE s.i < b0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.i >= k.b0 AND t.i < k.b1 AND {CLASH})),
m AS (SELECT split, avg(ret) AS m, count(*) AS trained FROM tr GROUP BY 1), x AS (SELECT split, trained, ret - m AS ret FROM s, k JOIN m USING (split) WHERE i >= b0 AND i < b1)
SELECT split, trained, {SUMMARY} FROM x GROUP BY 1, 2""",
)
def walk_forward_run(spark, d):
    returns, start, end = daily(spark, d)
    run = validation.run_walk_forward(spark, start, end, above_trained_mean(returns), NOTES, min_train=300, test_size=200, step=250, pct_embargo=0.01)
    return told_runs(run)


@C.add(
    "backtest__cpcv_distribution",
    f"""WITH {DAILY}, f AS (SELECT *, {fold_sql(6)} AS fold FROM s), g AS (SELECT DISTINCT fold AS g FROM f),
k AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS split, x.g AS g1, y.g AS g2 FROM g x JOIN g y ON x.g < y.g),
tr AS (SELECT split, s.ret FROM k, f s WHERE s.fold NOT IN (g1, g2) AND NOT EXISTS (SELECT 1 FROM f t WHERE t.fold IN (k.g1, k.g2) AND {CLASH})),
m AS (SELECT split, avg(ret) AS m FROM tr GROUP BY 1),
o AS (SELECT g, split, row_number() OVER (PARTITION BY g ORDER BY split) - 1 AS path FROM g JOIN k ON g IN (g1, g2)),
x AS (SELECT CAST(path AS INT) AS path, f.ret - m.m AS ret FROM o JOIN f ON f.fold = o.g JOIN m USING (split))
SELECT path, {SUMMARY} FROM x GROUP BY 1""",
)
def cpcv_distribution(spark, d):
    returns, start, end = daily(spark, d)
    run = validation.run_cpcv(spark, start, end, above_trained_mean(returns), NOTES, groups=6, test_groups=2, pct_embargo=0.01)
    return told_runs(run[1])


# Importance of features over all line items, in four folds

IMP = ["q", "dc", "tx", "ep"]
LINES4 = """v AS (SELECT l_orderkey * 8 + l_linenumber AS id, min(l_quantity) AS q, min(l_discount) AS dc, min(l_tax) AS tx, min(l_extendedprice) / 10000 AS ep,
  CASE WHEN max(l_returnflag) = 'R' THEN 1e0 ELSE 0e0 END AS y, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) % 4 AS fold FROM lineitem GROUP BY 1),
f AS (SELECT DISTINCT fold FROM v)"""
GAUSS = """g AS (SELECT fold, 1 AS k, m FROM a UNION ALL SELECT fold, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
  THEN list_transform(row, lambda c: c / m[k][k]) ELSE list_transform(row, lambda c, j: c - row[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= len(m)),
x AS (SELECT fold, list_transform(m, lambda row: row[-1]) AS x FROM g WHERE k = len(m) + 1)"""


def clipped(raw: str) -> str:
    return f"least(1 - 1e-6, greatest(1e-6, {raw}))"


def loss(p: str) -> str:
    return f"avg(CASE WHEN y = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


ALONE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, fold, {loss(clipped(f"(sy * sxx - sx * sxy) / (n * sxx - sx * sx) + (n * sxy - sx * sy) / (n * sxx - sx * sx) * {c}"))} AS v
  FROM v JOIN (SELECT f.fold, count(*) + 1e-3 AS n, sum({c}) AS sx, sum({c} * {c}) + 1e-3 AS sxx, sum(y) AS sy, sum({c} * y) AS sxy FROM f JOIN v ON v.fold <> f.fold GROUP BY 1) USING (fold) GROUP BY fold"""
    for c in IMP
)
SPREAD = f"SELECT feature, {r('avg(v)')} AS mean, {r('stddev_pop(v) / sqrt(count(*))')} AS std_error"


def lines(spark, d):
    li = domain.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("dc"), F.min("l_tax").alias("tx"), (F.min("l_extendedprice") / 10000).alias("ep"),
        F.when(F.max("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
    )
    return li.withColumn("fold", F.col("id") % 4)


@C.add("importance__single_features", f"WITH {LINES4}, s AS ({ALONE}) {SPREAD} FROM s GROUP BY 1")
def single_features(spark, d):
    return rounded(importance.single_feature_scores(lines(spark, d), IMP, "y", "fold"), "mean", "std_error")


FITTED = "x[1] + " + " + ".join(f"x[{k + 2}] * {c}" for k, c in enumerate(IMP))


@C.add(
    "importance__decrease_in_accuracy",
    f"""WITH RECURSIVE {LINES4}, z AS (SELECT fold, [1e0, q, dc, tx, ep] AS f, y FROM v),
cells AS (SELECT f.fold, i, j, sum(z.f[i] * CASE WHEN j = 6 THEN y ELSE z.f[j] END) + CASE WHEN i = j THEN 1e-3 ELSE 0 END AS c FROM f JOIN z ON z.fold <> f.fold, range(1, 6) p(i), range(1, 7) s(j) GROUP BY 1, 2, 3),
rows AS (SELECT fold, i, list(c ORDER BY j) AS row FROM cells GROUP BY 1, 2), a AS (SELECT fold, list(row ORDER BY i) AS m FROM rows GROUP BY 1), {GAUSS},
t AS (SELECT *, {", ".join(f"coalesce(lag({c}) OVER w, last_value({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS r_{c}" for c in IMP)} FROM v WINDOW w AS (PARTITION BY fold, id // 4096 ORDER BY id)),
l AS (SELECT fold, {loss(clipped(FITTED))} AS base, {", ".join(f"{loss(clipped(FITTED.replace(f'* {c}', f'* r_{c}')))} AS l_{c}" for c in IMP)} FROM t JOIN x USING (fold) GROUP BY 1),
s AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, (base - l_{c}) / -l_{c} AS v FROM l" for c in IMP)}) {SPREAD} FROM s GROUP BY 1""",
)
def decrease(spark, d):
    return rounded(importance.decrease_in_accuracy(lines(spark, d), IMP, "y", "fold", key="id"), "mean", "std_error")


# Sources and bars

@C.add(
    "data__clean_report",
    f"""WITH {CLEAN.format('DESC')}, s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM clean)
SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbol_count, CAST(0 AS BIGINT) AS duplicate_key_count, count(*) FILTER (step > 86400000000) AS gap_interval_count,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts_max, (SELECT count(*) FROM raw) - count(*) AS rows_removed_by_deduplication FROM s""",
)
def clean_report(spark, d):
    return ohlcv.clean_with_report(raw_ohlcv(spark, d), ordinal="key")[1]


#: Bars over OHLCV rows have the same SQL as bars over ticks, with the cleaned closes as ticks.
CLOSES = f"{CLEAN.format('DESC')}, t AS (SELECT symbol, ts, 0 AS ord, close AS price, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM clean)"


@C.add("bars__ohlcv_tick", f"WITH {CLOSES}, marked AS (SELECT *, CAST((rn - 1) // 25 AS BIGINT) AS bar_id FROM t QUALIFY (rn - 1) // 25 < count(*) OVER (PARTITION BY symbol) // 25) {BAR_SQL}")
def ohlcv_tick(spark, d):
    return told(bars.build_tick_bars(raw_ohlcv(spark, d), ticks_per_bar=25, ordinal="key"))


@C.add("bars__ohlcv_volume", sum_bars_sql("volume", 100).replace(NUMBERED, CLOSES))
def ohlcv_volume(spark, d):
    return told(bars.build_volume_bars(raw_ohlcv(spark, d), volume_per_bar=100, ordinal="key"))


@C.add("bars__ohlcv_dollar", sum_bars_sql("price * volume", 5_000_000).replace(NUMBERED, CLOSES))
def ohlcv_dollar(spark, d):
    return told(bars.build_dollar_bars(raw_ohlcv(spark, d), dollar_value_per_bar=5_000_000, ordinal="key"))


# Features of bars of ticks, and letters

BARS100 = f"""{TICKS}, s AS (SELECT *, price - lag(price) OVER w AS c, ln(price / lag(price) OVER w) AS lr, row_number() OVER w - 1 AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, ord)),
t AS (SELECT symbol, n, (n // 100 + 1) * 100 - 1 AS bar_end, price * volume AS dv, coalesce(c, 0) AS pd, abs(coalesce(lr, 0)) AS lr, volume,
  coalesce(last_value(CASE WHEN c <> 0 THEN sign(c) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS sg FROM s)"""


@C.add(
    "entropy__tick_features",
    f"""WITH {BARS100}, l AS (SELECT symbol, bar_end, coalesce(sum(volume * sg * pd) / nullif(sum(pow(volume * sg, 2)), 0), 0) AS kyle, coalesce(sum(dv * lr) / sum(dv * dv), 0) AS amihud,
  coalesce(sum(sqrt(dv) * sg * lr) / nullif(sum(pow(sqrt(dv) * sg, 2)), 0), 0) AS hasbrouck FROM t GROUP BY 1, 2),
n AS (SELECT symbol, bar_end, sg, count(*) AS k FROM t GROUP BY 1, 2, 3), h AS (SELECT symbol, bar_end, -sum(k / tot * log2(k / tot)) AS h FROM (SELECT *, sum(k) OVER (PARTITION BY symbol, bar_end) AS tot FROM n) GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, bar_end) AS m FROM t WINDOW w AS (PARTITION BY symbol, bar_end ORDER BY n)),
p AS (SELECT symbol, bar_end, k / sum(k) OVER (PARTITION BY symbol, bar_end) AS p FROM (SELECT symbol, bar_end, sg, count(*) AS k FROM x WHERE i < m GROUP BY 1, 2, 3)),
q AS (SELECT symbol, bar_end, -sum(p * log2(p)) AS q FROM p GROUP BY 1, 2)
SELECT symbol, bar_end, {r('kyle', 9)} AS kyle, {r('amihud', 9)} AS amihud, {r('hasbrouck', 9)} AS hasbrouck, {r('h')} AS tick_shannon, {r('coalesce(q, 0)')} AS tick_plug_in_1 FROM l JOIN h USING (symbol, bar_end) LEFT JOIN q USING (symbol, bar_end)""",
)
def tick_features(spark, d):
    t = domain.ticks(spark, d)
    found = entropy.tick_features(t, hundreds(t)).select("symbol", "bar_end", "kyle", "amihud", "hasbrouck", "tick_shannon", "tick_plug_in_1")
    return rounded(rounded(found, "kyle", "amihud", "hasbrouck", digits=9, keep_nan=True), "tick_shannon", "tick_plug_in_1")


def hundreds(t):
    """Boundaries after every hundred ticks of a symbol, the last bar included."""
    n = t.groupBy("symbol").agg(F.ceil(F.count("*") / 100).alias("n"))
    return n.select("symbol", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select("symbol", (F.col("k") * 100 - 1).alias("last"))


@C.add(
    "entropy__letters",
    f"""WITH {TICKS}, s AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS rk, count(*) OVER () AS n FROM ticks),
c AS (SELECT DISTINCT i, price AS v FROM range(8) t(i) JOIN s ON rk = floor((0.01e0 + 0.99e0 * i / 7) * (n - 1) + 0.5)),
b AS (SELECT min(price) AS lo, max(price) AS hi FROM ticks), g AS (SELECT unnest(range(CAST(ceil((hi - lo) / 25) AS BIGINT))) AS i, lo FROM b)
SELECT ord, (SELECT arg_min(i, (abs(price - v), i)) FROM c) AS quantile_letter, (SELECT arg_min(i, (abs(price - (lo + i * 25)), i)) FROM g) AS sigma_letter FROM ticks""",
)
def letters(spark, d):
    t = domain.ticks(spark, d)
    codes = entropy.quantile_codes(t, "price", 8), entropy.sigma_codes(t, "price", 25.0)
    by_quantile, by_sigma = (F.ascii(entropy.nearest_letter(F.col("price"), c)).cast("long") for c in codes)
    return t.select("ord", by_quantile.alias("quantile_letter"), by_sigma.alias("sigma_letter"))


# Histograms, weights within bounds, trading rules


@C.add(
    "codependence__histogram",
    f"""WITH {FEAT}, e AS (SELECT symbol, x, min(x) OVER s AS lo, max(x) OVER s AS hi FROM f WINDOW s AS (PARTITION BY symbol)),
b AS (SELECT symbol, CAST(least(floor((x - lo) / ((hi - lo) / 12)), 11) AS BIGINT) AS bin FROM e), g AS (SELECT DISTINCT symbol, unnest(range(12)) AS bin FROM e)
SELECT g.symbol, g.bin, count(b.bin) AS count FROM g LEFT JOIN b ON b.symbol = g.symbol AND b.bin = g.bin GROUP BY 1, 2""",
)
def histogram(spark, d):
    return dependence.histogram(features(spark, d), "x", 12)


@C.add("portfolio__critical_line")
def critical_line(spark, d):
    """Turning points within (0.05, 0.6); their optimality is tested by the conditions of Karush, Kuhn and Tucker."""
    inputs = portfolio.collect_inputs(domain.prices(spark, d))
    points = portfolio.critical_line(inputs.mu, inputs.cov, np.tile((0.05, 0.6), (len(inputs.assets), 1)))
    rows = [(k, a, float(w)) for k, p in enumerate(points) for a, w in zip(inputs.assets, p.weights, strict=True)]
    return spark.createDataFrame(rows, "point int, asset string, weight double")


@C.add("synthetic__otr_workflow")
def otr_workflow(spark, d):
    t = domain.ticks(spark, d)
    first = t.agg(F.min("symbol").alias("symbol"))
    one = t.join(F.broadcast(first), "symbol").select("symbol", "ts", "price")
    smooth = one.withColumn("price", F.avg("price").over(simulate.Window.partitionBy("symbol").orderBy("ts").rowsBetween(-9, 0)))
    surface = simulate.otr_workflow(smooth, n_paths=200, horizon=50, profit=[5.0, 10.0, 20.0], stop=[5.0, 10.0, 20.0], max_holding=40, seed=3)[1]
    return surface.orderBy("profit", "stop")


QUERIES, ORACLES = C.queries, C.oracles
