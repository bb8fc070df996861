"""Signals over events, entropies, portfolios, validation, learning, simulation, streaming, plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf_sql, norm_ppf_sql
from ..operators import entropy, etf, learning, portfolio, signals, simulate, validation
from ..plans import frames, pipeline
from ..sources import domain
from ..streaming import early_warning
from .base import PRICES, SPANS, TICKS, Catalog, r, rounded
from .statistics import RET, SIGNAL, returns

C = Catalog()

# Bet sizing over events

SIG = f"{SPANS}, b AS (SELECT symbol, id, start, \"end\", prob AS p, side AS s, side FROM spans), g AS (SELECT *, {SIGNAL} AS signal FROM b)"
ACTIVE = f"""{SIG}, pts AS (SELECT symbol, start AS ts FROM g UNION SELECT symbol, "end" FROM g),
act AS (SELECT p.symbol, p.ts, coalesce(avg(g.signal), 0) AS signal FROM pts p LEFT JOIN g ON g.symbol = p.symbol AND g.start <= p.ts AND p.ts < g."end" GROUP BY 1, 2)"""


def signalled(spark, d):
    from ..functions.bet_sizing import get_signal

    return domain.spans(spark, d).withColumn("signal", get_signal(F.col("prob"), 2, F.col("side")))


@C.add("bet_sizing__average_active_signals", f"WITH {ACTIVE} SELECT symbol, ts, {r('signal')} AS signal FROM act")
def average_active(spark, d):
    return rounded(signals.average_active_signals(signalled(spark, d)), "signal")


@C.add("bet_sizing__probability", f"WITH {SIG} SELECT symbol, start AS ts, {r('greatest(-1e0, least(1e0, round(signal / 0.05e0) * 0.05e0))')} AS size FROM g")
def probability(spark, d):
    return rounded(signals.bet_size_probability(domain.spans(spark, d), 2, 0.05), "size")


SIDES = f"""{SPANS}, cs AS (SELECT a.symbol, a.id, count(*) FILTER (b.side > 0) AS l, count(*) FILTER (b.side <= 0) AS s FROM spans a JOIN spans b ON a.symbol = b.symbol AND b.start <= a.start AND a.start < b."end" GROUP BY 1, 2)"""


@C.add("bet_sizing__concurrent_sides", f"WITH {SIDES} SELECT symbol, id, l AS active_long, s AS active_short FROM cs")
def sides(spark, d):
    return signals.concurrent_sides(domain.spans(spark, d)).select("symbol", "id", "active_long", "active_short")


@C.add("bet_sizing__budget", f"WITH {SIDES} SELECT symbol, id, {r('l / max(l) OVER (PARTITION BY symbol) - s / max(s) OVER (PARTITION BY symbol)')} AS size FROM cs")
def budget(spark, d):
    return rounded(signals.bet_size_budget(domain.spans(spark, d)), "size")


FIT = (-2.0, 3.0, 2.0, 2.5, 0.5)


def _mix(x: str) -> str:
    from ..functions.normal import norm_cdf_sql

    return f"(0.5 * {norm_cdf_sql(f'(({x} + 2e0) / 2e0)')} + 0.5 * {norm_cdf_sql(f'(({x} - 3e0) / 2.5e0)')})"


@C.add(
    "bet_sizing__reserve_with_fit",
    f"WITH {SIDES}, c AS (SELECT symbol, id, l, s, CAST(l - s AS DOUBLE) AS c FROM cs), f AS (SELECT *, {_mix('c')} AS fc, {_mix('0e0')} AS f0 FROM c) SELECT symbol, id, c, {r('CASE WHEN c >= 0 THEN (fc - f0) / (1 - f0) ELSE (fc - f0) / f0 END')} AS size FROM f",
)
def reserve(spark, d):
    return rounded(signals.bet_size_reserve(domain.spans(spark, d), FIT).select("symbol", "id", "c", "size"), "size")


@C.add("bet_sizing__reserve_fit")
def reserve_fit(spark, d):
    fit = signals.fit_reserve(domain.spans(spark, d), runs=100)
    return spark.createDataFrame([fit], "mu1 double, mu2 double, sigma1 double, sigma2 double, p1 double")


@C.add(
    "strategy_risk__failure_probability",
    f"""WITH {RET}, b AS (SELECT symbol, avg(ret) FILTER (ret > 0) AS win, avg(ret) FILTER (ret <= 0) AS loss, avg(CAST(ret > 0 AS DOUBLE)) AS p, count(*) / 6e0 AS f FROM ret GROUP BY 1),
q AS (SELECT *, (f + 1) * pow(win - loss, 2) AS qa, (2 * f * loss - (win - loss)) * (win - loss) AS qb, f * loss * loss AS qc FROM b),
z AS (SELECT *, list_min(list_filter([(-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa), (-qb + sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa)], lambda x: x >= 0 AND x <= 1 AND (win - loss) * x + loss >= 0)) AS needed FROM q WHERE qb * qb - 4 * qa * qc >= 0),
u AS (SELECT z.*, (i - 0.5e0) / 500 AS u FROM z, range(1, 501) t(i)),
s AS (SELECT *, least(1e0, greatest(0e0, p + sqrt(p * (1 - p) / greatest(1, floor(f * 2))) * {norm_ppf_sql('u')})) AS drawn FROM u),
h AS (SELECT symbol, greatest(1.06 * stddev_samp(drawn) * pow(500, -0.2), 1e-3) AS h FROM s GROUP BY 1)
SELECT symbol, {r('win')} AS win, {r('loss')} AS loss, {r('p')} AS "precision", {r('f')} AS frequency, {r('needed')} AS needed, {r('avg(CAST(drawn <= needed AS DOUBLE))')} AS empirical,
  {r(f"avg({norm_cdf_sql('((needed - drawn) / h)')})")} AS smoothed FROM s JOIN h USING (symbol) GROUP BY symbol, win, loss, p, f, needed""",
)
def failure(spark, d):
    found = signals.strategy_failure(returns(spark, d), target_sharpe=1.0, years=6.0)
    return rounded(found, "win", "loss", "precision", "frequency", "needed", "empirical", "smoothed")


# Entropies

MSG = f"{TICKS}, s AS (SELECT symbol, ord, ts, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM ticks), msg AS (SELECT symbol, ts, CASE WHEN c > 0 THEN 'a' WHEN c < 0 THEN 'b' ELSE 'c' END AS c FROM s)"


def tick_messages(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    t = domain.ticks(spark, d).select("symbol", "ts", F.signum(F.col("price") - F.lag("price").over(w)).alias("_s")).withColumn("sign", F.coalesce("_s", F.lit(0.0)))
    return entropy.messages(t, entropy.encode_tick_rule("sign"))


@C.add("entropy__messages", f"WITH {MSG} SELECT symbol, string_agg(c, '' ORDER BY ts) AS message FROM msg GROUP BY symbol")
def message(spark, d):
    return tick_messages(spark, d)


@C.add("entropy__shannon", f"WITH {MSG}, n AS (SELECT symbol, c, count(*) AS n FROM msg GROUP BY 1, 2), p AS (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM n) SELECT symbol, {r('-sum(p * log2(p))')} AS shannon FROM p GROUP BY symbol")
def shannon(spark, d):
    return rounded(entropy.shannon(tick_messages(spark, d)), "shannon")


def plug_in_sql(k: int) -> str:
    word = "c" if k == 1 else "c || lead(c) OVER (PARTITION BY symbol ORDER BY ts)"
    return f"""WITH {MSG}, x AS (SELECT symbol, {word} AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM msg),
n AS (SELECT symbol, w, count(*) AS k FROM x WHERE i <= n - {k} GROUP BY 1, 2), p AS (SELECT symbol, k / sum(k) OVER (PARTITION BY symbol) AS p FROM n) SELECT symbol, {r(f'-sum(p * log2(p)) / {k}')} AS plug_in FROM p GROUP BY symbol"""


def register_plug_in(k: int):
    @C.add(f"entropy__plug_in_{k}", plug_in_sql(k))
    def query(spark, d):
        e = entropy.entropies(tick_messages(spark, d))
        return rounded(e.select("symbol", F.col(f"plug_in_{k}").alias("plug_in")), "plug_in")


register_plug_in(1)
register_plug_in(2)


@C.add("entropy__sequential")
def sequential(spark, d):
    return rounded(entropy.entropies(tick_messages(spark, d)).select("symbol", "lempel_ziv", "kontoyiannis", "kontoyiannis_window"), "lempel_ziv", "kontoyiannis", "kontoyiannis_window")


@C.add(
    "entropy__bar_features",
    f"""WITH {TICKS}, s AS (SELECT *, price - lag(price) OVER w AS c, row_number() OVER w - 1 AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, ord)),
t AS (SELECT *, coalesce(last_value(CASE WHEN c <> 0 THEN sign(c) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, ord ROWS UNBOUNDED PRECEDING), 0) AS sg, (n // 100 + 1) * 100 - 1 AS bar_end FROM s)
SELECT symbol, bar_end, max(ts) AS ts, {r('avg(volume)')} AS average_tick_size, {r('sum(sg)')} AS tick_rule_sum, {r('sum(price * volume) / sum(volume)')} AS vwap,
  string_agg(CASE WHEN sg = 1 THEN 'a' WHEN sg = -1 THEN 'b' ELSE 'c' END, '' ORDER BY n) AS message FROM t GROUP BY 1, 2""",
)
def bar_features(spark, d):
    t = domain.ticks(spark, d)
    bars = t.groupBy("symbol").agg(F.ceil(F.count("*") / 100).alias("n"))
    marks = bars.select("symbol", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select("symbol", (F.col("k") * 100 - 1).alias("last"))
    return rounded(entropy.bar_features(t, marks), "average_tick_size", "tick_rule_sum", "vwap")


# Portfolios

LRET = f"{PRICES}, lr AS (SELECT ts, asset, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY ts)) AS ret FROM prices QUALIFY ret IS NOT NULL)"
COV = f"{LRET}, cov AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) AS cov FROM lr x JOIN lr y USING (ts) GROUP BY 1, 2)"


@C.add("portfolio__covariance", f"WITH {COV} SELECT a, b, {r('cov')} AS cov FROM cov")
def covariance(spark, d):
    return rounded(portfolio.covariance(portfolio.log_returns(domain.prices(spark, d))), "cov")


@C.add("portfolio__expected_returns", f"WITH {LRET} SELECT asset, {r('avg(ret) * 252')} AS mu FROM lr GROUP BY asset")
def expected(spark, d):
    return rounded(portfolio.expected_returns(portfolio.log_returns(domain.prices(spark, d))), "mu")


@C.add("portfolio__expected_returns_exponential", f"WITH {LRET}, a AS (SELECT asset, ret, pow(1 - 2e0 / 501, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) - 1) AS w FROM lr) SELECT asset, {r('sum(ret * w) / sum(w) * 252')} AS mu FROM a GROUP BY asset")
def expected_exponential(spark, d):
    return rounded(portfolio.expected_returns(portfolio.log_returns(domain.prices(spark, d)), "exponential"), "mu")


@C.add("portfolio__resample_weekly", f"WITH {PRICES}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM prices) SELECT ts, asset, {r('price')} AS price FROM n WHERE n % 5 = 0")
def weekly(spark, d):
    return rounded(portfolio.resample(domain.prices(spark, d), 5), "price")


@C.add("portfolio__inverse_variance", f"WITH {LRET}, v AS (SELECT asset, 1 / var_samp(ret) AS iv FROM lr GROUP BY asset) SELECT asset, {r('iv / sum(iv) OVER ()')} AS weight FROM v")
def inverse_variance(spark, d):
    return rounded(portfolio.inverse_variance(domain.prices(spark, d)), "weight")


@C.add("risk__portfolio_variance", f"WITH {COV} SELECT {r('sum(0.2 * cov * 0.2)')} AS variance FROM cov")
def variance(spark, d):
    p = domain.prices(spark, d)
    cov = portfolio.covariance(portfolio.log_returns(p))
    from ..operators.stats import portfolio_variance

    return rounded(portfolio_variance(cov, p.select("asset").distinct().withColumn("weight", F.lit(0.2))), "variance")


#: Gauss-Jordan elimination of the augmented matrix [[...], ...] that `a` has as m; `x` has the list of solutions. Covariances
#: are positive definite, so no rows have to be exchanged.
SOLVE = """g AS (SELECT 1 AS k, m FROM a UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
  THEN list_transform(row, lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END) FROM g WHERE k <= len(m)),
x AS (SELECT list_transform(m, lambda row: row[-1]) AS x FROM g WHERE k = len(m) + 1)"""
MU = "mu AS (SELECT asset, avg(ret) * 252 AS mu FROM lr GROUP BY asset)"


def solved_sql(right: str, cov: str = COV) -> str:
    """(n, asset, mu, s) with s the solution of cov * s = right, an expression of mu."""
    return f"""{cov}, {MU}, rows AS (SELECT a, list_append(list(cov ORDER BY b), any_value({right})) AS row FROM cov JOIN mu ON a = mu.asset GROUP BY a),
a AS (SELECT list(row ORDER BY a) AS m FROM rows), {SOLVE}, names AS (SELECT asset, mu, row_number() OVER (ORDER BY asset) AS n FROM mu),
w AS (SELECT asset, mu, x[n] AS s FROM names, x)"""


SIMPLE_COV = COV.replace("ln(price / lag(price) OVER (PARTITION BY asset ORDER BY ts))", "price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1")


def two_solutions_sql(cov: str) -> str:
    """(asset, mu, si, sm, a, b, c): solutions for ones and for the means, and their products."""
    one, mean = solved_sql("1e0", cov), solved_sql("mu", cov)
    return f"""one AS (WITH RECURSIVE {one} SELECT * FROM w), mean AS (WITH RECURSIVE {mean} SELECT * FROM w),
both_ AS (SELECT one.asset, one.mu, one.s AS si, mean.s AS sm FROM one JOIN mean USING (asset)),
t AS (SELECT *, sum(si) OVER () AS a, sum(sm) OVER () AS b, sum(mu * sm) OVER () AS c FROM both_)"""


def register_allocation(name: str, build, sql: str | None = None):
    @C.add(f"portfolio__{name}", sql)
    def query(spark, d):
        got = build(domain.prices(spark, d))
        return rounded(got.frame(spark), "weight")


def tangent_sql(right: str, cov: str = COV) -> str:
    return f"WITH RECURSIVE {solved_sql(right, cov)} SELECT asset, {r('s / sum(s) OVER ()')} AS weight FROM w"


register_allocation("min_volatility", lambda p: portfolio.allocate(p, "min_volatility", bounds=(0.0, 1.0)), tangent_sql("1e0"))
register_allocation("max_sharpe", lambda p: portfolio.allocate(p, "max_sharpe"), tangent_sql("mu"))
register_allocation(
    "efficient_risk",
    lambda p: portfolio.allocate(p, "efficient_risk", target_return=0.05),
    f"WITH {two_solutions_sql(COV)} SELECT asset, {r('((c - b * 0.05) * si + (a * 0.05 - b) * sm) / (a * c - b * b)')} AS weight FROM t",
)
register_allocation("cla_min_volatility", lambda p: portfolio.cla_allocate(p, "min_volatility"), tangent_sql("1e0", SIMPLE_COV))
register_allocation("hrp", portfolio.allocate_hrp)
for _metric in portfolio.HCAA_METRICS:
    register_allocation(f"hcaa_{_metric}", lambda p, m=_metric: portfolio.allocate_hcaa(p, m))


@C.add(
    "portfolio__cla_frontier",
    f"""WITH {two_solutions_sql(SIMPLE_COV)}, u AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, max(mu) AS top FROM t),
k AS (SELECT i, b / a + (top - b / a) * i / 99e0 AS m, a, b, c FROM u, range(100) r(i))
SELECT {r('sqrt((a * m * m - 2 * b * m + c) / (a * c - b * b))')} AS volatility, {r("m")} AS "return", CAST(i AS VARCHAR) AS point_id FROM k""",
)
def frontier(spark, d):
    points = portfolio.cla_allocate(domain.prices(spark, d), "efficient_frontier", bounds=None)
    return rounded(frames.frontier_frame(spark, [float(p.risk) for p in points], [float(p.expected) for p in points]), "volatility", "return")


@C.add("portfolio__onc")
def onc(spark, d):
    cov = portfolio.collect_inputs(domain.prices(spark, d))
    groups, silhouette = portfolio.onc_clusters(portfolio.cov_to_corr(cov.cov), repeat=3)
    rows = [(cov.assets[i], c, float(silhouette[i])) for c, g in enumerate(groups) for i in g]
    return spark.createDataFrame(rows, "asset string, cluster int, silhouette double")


# ETF trick, futures


@C.add(
    "etf__trick",
    f"""WITH RECURSIVE o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS security, arg_min(o_totalprice, o_orderkey) AS op, arg_max(o_totalprice, o_orderkey) AS cl FROM orders GROUP BY 1, 2),
f AS (SELECT dd.date, ss.security, coalesce(op, 150000e0) AS op, coalesce(cl, 150000e0) AS cl, CASE WHEN dd.date[6:7] < '07' THEN 0.2e0 ELSE length(ss.security) / 20e0 END AS al
  FROM (SELECT DISTINCT date FROM o) dd CROSS JOIN (SELECT DISTINCT security FROM o) ss LEFT JOIN o ON o.date = dd.date AND o.security = ss.security),
l AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, list(op ORDER BY security) AS o, list(cl ORDER BY security) AS c, list(al ORDER BY security) AS a, sum(abs(al)) AS g FROM f GROUP BY date),
w AS (SELECT CAST(1 AS BIGINT) AS i, x.date, 1e0 AS k, list_transform(x.a, lambda v, j: v / (y.o[j] * x.g)) AS held, false AS changed, x.a AS before, true AS first FROM l x JOIN l y ON y.i = 2 WHERE x.i = 1
UNION ALL SELECT i, date, k + list_sum(list_transform(now, lambda h, j: h * (c[j] - (CASE WHEN changed THEN o[j] ELSE c0[j] END) + 0.5e0))), now, first OR list_sum(list_transform(a, lambda v, j: abs(v - before[j]))) > 0, a, false
  FROM (SELECT x.i, x.date, w.k, w.changed, w.before, w.first, x.a, x.c, x.o, p.c AS c0, CASE WHEN w.changed THEN list_transform(x.a, lambda v, j: v * w.k / (y.o[j] * x.g)) ELSE w.held END AS now
    FROM w JOIN l x ON x.i = w.i + 1 JOIN l y ON y.i = w.i + 2 JOIN l p ON p.i = w.i))
SELECT date, {r('k')} AS value FROM w""",
)
def etf_trick(spark, d):
    o = domain.read(spark, d, "orders")
    by = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("security"))
    t = by.agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    every = t.select("date").distinct().crossJoin(F.broadcast(t.select("security").distinct()))
    full = every.join(t, ["date", "security"], "left").na.fill({"open": 150000.0, "close": 150000.0})
    full = full.withColumns({"alloc": F.when(F.substring("date", 6, 2) < "07", 0.2).otherwise(F.length("security") / 20.0), "cost": F.lit(0.5), "rate": F.lit(1.0)})
    return rounded(etf.etf_trick(full), "value")


ROLL = """fr AS (SELECT o_orderpriority AS root, o_orderdate AS date, avg(o_totalprice) AS open, avg(o_totalprice) + 1 AS close, strftime(o_orderdate, '%Y') AS security FROM orders GROUP BY 1, 2)"""


def roll_rows(spark, d):
    by = domain.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("root"), F.col("o_orderdate").alias("date"))
    return by.agg(F.avg("o_totalprice").alias("open"), (F.avg("o_totalprice") + 1).alias("close")).withColumns({"security": F.date_format("date", "yyyy"), "current_security": F.date_format("date", "yyyy")})


def roll_sql(gap: str, total: str, unit: str, back: str = "") -> str:
    return f"""WITH {ROLL}, g AS (SELECT root, date, CASE WHEN security <> lag(security) OVER w THEN {gap} ELSE {unit} END AS g FROM fr WINDOW w AS (PARTITION BY root ORDER BY date)),
t AS (SELECT root, date, {total} OVER (PARTITION BY root ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM g) SELECT root, date, {r(f'v {back}')} AS gap FROM t"""


LAST = "last_value(v) OVER (PARTITION BY root ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@C.add("futures__roll_absolute", roll_sql("open - lag(close) OVER w", "sum(g)", "0"))
def roll_absolute(spark, d):
    return rounded(etf.futures_roll(roll_rows(spark, d), "absolute"), "gap")


@C.add("futures__roll_relative_backward", roll_sql("open / lag(close) OVER w", "product(g)", "1", f"/ {LAST}"))
def roll_relative(spark, d):
    return rounded(etf.futures_roll(roll_rows(spark, d), "relative", roll_backward=True), "gap")


# Validation

VSPANS = "v AS (SELECT o_orderkey AS id, o_orderdate AS start, o_orderdate + to_days(CAST(o_custkey % 9 AS INT)) AS \"end\" FROM orders)"


def order_spans(spark, d):
    days = F.make_dt_interval((F.col("o_custkey") % 9).cast("int"))
    return domain.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + days).alias("end"))


@C.add(
    "cv__train_times",
    f'WITH {VSPANS}, t AS (SELECT * FROM v WHERE id % 500 = 0) SELECT id, start, "end" FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE v.start <= t."end" AND v."end" >= t.start)',
)
def train_times(spark, d):
    s = order_spans(spark, d)
    return validation.train_times(s, s.where("id % 500 = 0"))


def span_arrays(n: int = 600):
    start = np.arange(n)
    return start, start + 3 + start % 5


def split_frame(spark, splits):
    rows = [(i, int(x), part) for i, (train, test) in enumerate(splits) for part, xs in (("train", train), ("test", test)) for x in xs]
    return spark.createDataFrame(rows, "split int, idx int, part string")


PURGED = """WITH s AS (SELECT CAST(i AS INT) AS i, i AS a, i + 3 + i % 5 AS b, CAST(i // 100 AS INT) AS fold FROM range(600) t(i)), f AS (SELECT DISTINCT fold AS split FROM s)
SELECT split, i AS idx, 'test' AS part FROM s JOIN f ON split = fold UNION ALL
SELECT split, i, 'train' FROM s, f WHERE fold <> split AND NOT EXISTS (SELECT 1 FROM s t WHERE t.fold = f.split AND (abs(t.i - s.i) <= 6 OR (s.a <= t.b AND s.b >= t.a)))"""


@C.add("cv__purged_kfold", PURGED)
def kfold(spark, d):
    return split_frame(spark, validation.purged_kfold(*span_arrays(), 6, 0.01))


@C.add(
    "backtest__walk_forward",
    """WITH s AS (SELECT CAST(i AS INT) AS i, i AS a, i + 3 + i % 5 AS b FROM range(600) t(i)), f AS (SELECT CAST(k AS INT) AS split, 300 + 50 * k AS b0 FROM range(6) t(k))
SELECT split, i AS idx, 'test' AS part FROM s, f WHERE i >= b0 AND i < b0 + 50 UNION ALL
SELECT split, i, 'train' FROM s, f WHERE i < b0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.i >= b0 AND t.i < b0 + 50 AND (abs(t.i - s.i) <= 6 OR (s.a <= t.b AND s.b >= t.a)))""",
)
def forward(spark, d):
    return split_frame(spark, validation.walk_forward(*span_arrays(), 300, 50, 50, 0.01))


@C.add("backtest__cpcv_paths", "SELECT CAST(6 AS INT) AS groups, CAST(2 AS INT) AS test_groups, CAST(15 AS INT) AS splits, CAST(5 AS INT) AS paths")
def cpcv_paths(spark, d):
    splits, _, paths = validation.cpcv(*span_arrays(), 6, 2, 0.01)
    return spark.createDataFrame([(6, 2, len(splits), len(paths))], "groups int, test_groups int, splits int, paths int")


@C.add(
    "backtest__cpcv_performance",
    f"""WITH k AS (SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS INT) AS split, x, y FROM range(6) a(x), range(6) b(y) WHERE x < y),
x AS (SELECT split, sin(i) / 100 + 0.001e0 AS ret FROM k, range(600) t(i) WHERE i // 100 IN (x, y))
SELECT split, count(*) AS n, {r('avg(ret)')} AS mean, {r('stddev_samp(ret)')} AS std, {r('avg(ret) / stddev_samp(ret) * sqrt(count(*))')} AS sharpe FROM x GROUP BY 1""",
)
def cpcv_run(spark, d):
    splits, _, _ = validation.cpcv(*span_arrays(), 6, 2, 0.01)
    return rounded(validation.summarize(validation.run_splits(spark, splits, lambda train, test: np.sin(test) / 100 + 0.001)), "mean", "std", "sharpe")


XY = "xy AS (SELECT l_quantity AS q, l_discount AS dc, l_tax AS tx, l_extendedprice / 10000 AS ep, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y FROM lineitem)"
FEATURES = ["q", "dc", "tx", "ep"]


def xy(spark, d):
    return domain.read(spark, d, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("dc"), F.col("l_tax").alias("tx"), (F.col("l_extendedprice") / 10000).alias("ep"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
    )


def small_xy(n: int = 400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4))
    x[:, 1] = 0.96 * x[:, 0] + 0.04 * x[:, 1]
    y = (x[:, 0] + 0.3 * x[:, 2] + rng.normal(0, 0.5, n) > 0).astype(float)
    return x, y


def pandas_query(name: str, build):
    @C.add(name)
    def query(spark, d):
        return spark.createDataFrame(build())


_SPLITS = validation.purged_kfold(np.arange(400), np.arange(400) + 2, 4, 0.01)
_NAMES = ["f0", "f1", "f2", "f3"]
pandas_query("importance__mda", lambda: learning.mean_decrease_accuracy(validation.LinearProbability(), *small_xy(), _NAMES, _SPLITS))
pandas_query("importance__sfi", lambda: learning.single_feature_importance(validation.LinearProbability(), *small_xy(), _NAMES, _SPLITS))
pandas_query("importance__mdi_bootstrap", lambda: learning.bootstrap_mdi(*small_xy(), _NAMES))
pandas_query("importance__substitution", lambda: learning.substitution_report(validation.LinearProbability(), *small_xy(), _NAMES, _SPLITS))


NORMAL = "[1e0, q, dc, tx, ep]"


@C.add(
    "cv__linear_probability_fit",
    f"""WITH RECURSIVE {XY}, v AS (SELECT {NORMAL} AS f, y FROM xy), cells AS (SELECT i, j, sum(f[i] * CASE WHEN j = 6 THEN y ELSE f[j] END) + CASE WHEN i = j THEN 1e-3 ELSE 0 END AS c
  FROM v, range(1, 6) a(i), range(1, 7) b(j) GROUP BY 1, 2), rows AS (SELECT i, list(c ORDER BY j) AS row FROM cells GROUP BY i), a AS (SELECT list(row ORDER BY i) AS m FROM rows), {SOLVE}
SELECT (['intercept', 'q', 'dc', 'tx', 'ep'])[n] AS name, {r('x[n]')} AS coef FROM x, range(1, 6) t(n)""",
)
def linear_fit(spark, d):
    coef = validation.fit_linear_probability(xy(spark, d), FEATURES, "y")
    return rounded(spark.createDataFrame([(n, float(c)) for n, c in zip(["intercept", *FEATURES], coef, strict=True)], "name string, coef double"), "coef")


@C.add("search__grid")
def grid(spark, d):
    x, y = small_xy()
    _, means = validation.search(spark, lambda p: validation.LinearProbability(**p), validation.expand_grid({"ridge": [1e-3, 1.0, 100.0]}), x, y, _SPLITS)
    return rounded(means, "score")


@C.add("search__random")
def random(spark, d):
    x, y = small_xy()
    params = validation.draw_params({"ridge": ("log_uniform", 1e-3, 1e2)}, 4, 5)
    _, means = validation.search(spark, lambda p: validation.LinearProbability(**p), params, x, y, _SPLITS, "accuracy")
    return rounded(means, "score")


@C.add(
    "screen__features",
    f"""WITH {XY}, s AS (SELECT unnest(['q', 'dc', 'tx', 'ep']) AS feature, unnest([stddev_samp(q), stddev_samp(dc), stddev_samp(tx), stddev_samp(ep)]) AS sd FROM xy)
SELECT feature, 1e0 AS coverage, {r('sd')} AS std, true AS accepted FROM s""",
)
def screen(spark, d):
    got = learning.feature_screen(xy(spark, d), FEATURES, max_correlation=0.9999)
    return rounded(spark.createDataFrame(got[["feature", "coverage", "std", "accepted"]]), "std")


@C.add("importance__orthogonal_features")
def orthogonal(spark, d):
    out, _, _ = learning.orthogonal_features(xy(spark, d), FEATURES, 0.95)
    return out.agg(*[F.round(F.var_pop(c), 4).alias(c) for c in out.columns])


PREDS = "pr AS (SELECT l_orderkey * 10 + l_linenumber AS sample, l_suppkey % 5 AS model, avg(l_discount * 10) AS value FROM lineitem GROUP BY 1, 2)"


def preds(spark, d):
    li = domain.read(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), (F.col("l_suppkey") % 5).alias("model")).agg(F.avg(F.col("l_discount") * 10).alias("value"))


@C.add("ensemble__regression_mean", f"WITH {PREDS} SELECT sample, {r('avg(value)')} AS value FROM pr GROUP BY sample")
def ens_mean(spark, d):
    return rounded(learning.regression_mean(preds(spark, d)), "value")


@C.add("ensemble__vote", f"WITH {PREDS} SELECT sample, CAST(2 * sum(CAST(value > 0.5 AS INT)) >= count(*) AS INT) AS label FROM pr GROUP BY sample")
def ens_vote(spark, d):
    return learning.classification_vote(preds(spark, d).withColumn("value", (F.col("value") > 0.5).cast("int")))


@C.add("ensemble__probability_mean", f"WITH {PREDS} SELECT sample, {r('avg(value)')} AS probability, CAST(avg(value) >= 0.4523 AS INT) AS label FROM pr GROUP BY sample")
def ens_probability(spark, d):
    return rounded(learning.probability_mean(preds(spark, d), 0.4523), "probability")


@C.add(
    "ensemble__bias_variance_noise",
    f"""WITH {PREDS}, t AS (SELECT DISTINCT sample, (sample % 11) / 11.0e0 AS y FROM pr), b AS (SELECT sample, y, avg(value) AS m, var_pop(value) AS v, avg(pow(value - y, 2)) AS e FROM pr JOIN t USING (sample) GROUP BY 1, 2),
s AS (SELECT avg(pow(m - y, 2)) AS b, avg(v) AS v, avg(e) AS e FROM b) SELECT {r('b')} AS bias_sq, {r('v')} AS variance, {r('e')} AS mse, {r('greatest(0e0, e - b - v)')} AS noise FROM s""",
)
def bvn(spark, d):
    p = preds(spark, d)
    truth = p.select("sample").distinct().withColumn("y", (F.col("sample") % 11) / 11.0)
    return rounded(learning.bias_variance_noise(p, truth), "bias_sq", "variance", "mse", "noise")


@C.add("ensemble__pairwise_correlation", f"WITH {PREDS}, c AS (SELECT a.model AS x, b.model AS y, corr(a.value, b.value) AS r FROM pr a JOIN pr b ON a.sample = b.sample AND a.model < b.model GROUP BY 1, 2) SELECT {r('avg(coalesce(r, 0))')} AS correlation FROM c")
def pairwise(spark, d):
    return rounded(learning.average_pairwise_correlation(preds(spark, d)), "correlation")


BAGS = "bag AS (SELECT l_suppkey % 7 AS estimator, l_quantity AS x, l_extendedprice AS y, CAST(l_returnflag = 'R' AS DOUBLE) AS lab FROM lineitem), rw AS (SELECT event_id AS sample, value / 10 AS x FROM events)"


def bags(spark, d):
    li = domain.read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("estimator"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("lab"))
    return li, domain.read(spark, d, "events").select(F.col("event_id").alias("sample"), (F.col("value") / 10).alias("x"))


@C.add("bagging__regressor", f"WITH {BAGS}, f AS (SELECT avg(b) AS b, avg(a) AS a FROM (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM bag GROUP BY estimator)) SELECT sample, {r('a + b * x', 3)} AS value FROM rw, f")
def bag_regression(spark, d):
    return rounded(learning.bagging_regression(*bags(spark, d)), "value", digits=3)


@C.add(
    "bagging__classifier",
    f"""WITH {BAGS}, l2 AS (SELECT estimator, x, CAST(x > 25 OR lab = 1 AS DOUBLE) AS y FROM bag), c AS (SELECT estimator, avg(x) AS cut FROM l2 GROUP BY 1),
s AS (SELECT estimator, cut, avg(y) FILTER (x > cut) >= 0.5 AS up, avg(y) FILTER (x <= cut) >= 0.5 AS dn FROM l2 JOIN c USING (estimator) GROUP BY 1, 2)
SELECT sample, CAST(2 * sum(CAST(CASE WHEN x > cut THEN up ELSE dn END AS INT)) >= count(*) AS INT) AS label FROM rw, s GROUP BY sample""",
)
def bag_stumps(spark, d):
    li, rows = bags(spark, d)
    return learning.bagging_stumps(li.withColumn("y", ((F.col("x") > 25) | (F.col("lab") == 1)).cast("double")), rows)


@C.add("importance__mdi", f"WITH t AS (SELECT l_suppkey % 9 AS tree, l_linenumber AS feature, CASE WHEN l_linenumber = 3 THEN 0 ELSE avg(l_discount) END AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT feature, coalesce(avg(nullif(v, 0)), 0) AS m, coalesce(stddev_pop(nullif(v, 0)) / sqrt(count(nullif(v, 0))), 0) AS e FROM t GROUP BY 1) SELECT feature, {r('m / sum(m) OVER ()')} AS mean, {r('e / sum(m) OVER ()')} AS std_error FROM s")
def mdi(spark, d):
    li = domain.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("tree"), F.col("l_linenumber").alias("feature")).agg(F.avg("l_discount").alias("v"))
    trees = li.withColumn("importance", F.when(F.col("feature") == 3, 0.0).otherwise(F.col("v")))
    return rounded(learning.mean_decrease_impurity(trees), "mean", "std_error")


def linear_model(x):
    return 2 * x[:, 0] + np.sin(x[:, 1]) + x[:, 0] * x[:, 2]


@C.add(
    "fingerprint__partial_dependence",
    f"""WITH {XY}, g AS (SELECT unnest(quantile_cont(q, [0, 0.25, 0.5, 0.75, 1])) AS q FROM xy), p AS (SELECT g.q AS value, avg(2 * g.q + sin(dc) + g.q * tx) AS m FROM (SELECT dc, tx FROM xy), (SELECT DISTINCT q FROM g) g GROUP BY 1)
SELECT 'q' AS feature, {r('value')} AS value, {r('m')} AS mean FROM p""",
)
def partial(spark, d):
    rows = xy(spark, d).select("q", "dc", "tx")
    grid = learning.feature_grid(rows, ["q", "dc", "tx"], 5)
    got = learning.partial_dependence(rows, ["q", "dc", "tx"], linear_model, {"q": sorted(set(grid["q"])), "dc": [], "tx": []})
    return rounded(got, "value", "mean")


@C.add("fingerprint__effects")
def effects(spark, d):
    rows = xy(spark, d).select("q", "dc", "tx")
    grid = learning.feature_grid(rows, ["q", "dc", "tx"], 5)
    return rounded(learning.fingerprint(learning.partial_dependence(rows, ["q", "dc", "tx"], linear_model, grid)), "linear", "non_linear", "linear_share", "non_linear_share")


# Simulation


@C.add(
    "synthetic__calibrate_ou",
    f"""WITH {PRICES}, x AS (SELECT asset AS symbol, price AS y, lag(price) OVER (PARTITION BY asset ORDER BY ts) AS x FROM prices), f AS (SELECT symbol, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY 1)
SELECT symbol, {r('phi')} AS phi, {r('c', 3)} AS intercept, {r('c / (1 - phi)', 3)} AS equilibrium, {r('sqrt((syy - phi * sxy) / (n - 1))', 3)} AS sigma, {r('r2')} AS r_squared, phi > 0 AND phi < 1 AS stationary FROM f""",
)
def ou(spark, d):
    got = simulate.calibrate_ou(domain.prices(spark, d).withColumnRenamed("asset", "symbol"))
    return rounded(rounded(got, "intercept", "equilibrium", "sigma", digits=3), "phi", "r_squared")


@C.add("synthetic__rule_surface")
def surface(spark, d):
    paths = simulate.ou_paths(spark, simulate.OuParams(0.9, 100.0, 1.0), 99.0, 200, 60, seed=11)
    return rounded(simulate.rule_surface(paths, [0.5, 1.0, 2.0], [0.5, 1.0, 2.0], 50), "mean", "std", "win_rate", "holding", "sharpe")


@C.add(
    "synthetic__rule_surface_of_ticks",
    f"""WITH {TICKS}, n AS (SELECT CASE symbol WHEN 'click' THEN 0 ELSE 1 END AS k, symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, price FROM ticks),
p AS (SELECT hash(symbol) AS h, symbol, i // 20 AS g, i % 20 AS step, price - first_value(price) OVER (PARTITION BY symbol, i // 20 ORDER BY i) AS pnl FROM n),
rl AS (SELECT unnest([50e0, 100e0]) AS profit, 80e0 AS stop), e AS (SELECT profit, stop, symbol, g, step, pnl, pnl >= profit OR pnl <= -stop AS hit FROM p, rl WHERE step BETWEEN 1 AND 15),
x AS (SELECT profit, stop, symbol, g, coalesce(min(step) FILTER (hit), max(step)) AS s FROM e GROUP BY 1, 2, 3, 4), y AS (SELECT x.*, e.pnl FROM x JOIN e ON e.profit = x.profit AND e.symbol = x.symbol AND e.g = x.g AND e.step = x.s)
SELECT profit, stop, {r('avg(pnl)')} AS mean, {r('stddev_samp(pnl)')} AS std, {r('avg(CAST(pnl > 0 AS DOUBLE))')} AS win_rate, {r('avg(s)')} AS holding, {r('avg(pnl) / stddev_samp(pnl) * sqrt(252 / avg(s))')} AS sharpe FROM y GROUP BY 1, 2""",
)
def tick_surface(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    t = domain.ticks(spark, d).select("symbol", (F.row_number().over(w) - 1).alias("i"), "price")
    paths = t.select(F.concat_ws("/", "symbol", F.floor(F.col("i") / 20)).alias("path"), (F.col("i") % 20).alias("step"), "price")
    return rounded(simulate.rule_surface(paths, [50.0, 100.0], [80.0], 15), "mean", "std", "win_rate", "holding", "sharpe")


@C.add("combinatorial__decisions", "SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS id, a, b, c FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(0, 10, 3)) AS b), (SELECT unnest(range(1, 4)) AS c)")
def decisions(spark, d):
    v = [simulate.Variable("a", -2, 2), simulate.Variable("b", 0, 9, 3), simulate.Variable("c", 1, 3)]
    return simulate.decisions(spark, v)


@C.add("combinatorial__exact", "WITH v AS (SELECT a, b, c FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(0, 10, 3)) AS b), (SELECT unnest(range(1, 4)) AS c)) SELECT a, b, c, CAST(a * b - c * c + b AS BIGINT) AS objective FROM v ORDER BY objective DESC, a, b, c LIMIT 1")
def exact(spark, d):
    v = [simulate.Variable("a", -2, 2), simulate.Variable("b", 0, 9, 3), simulate.Variable("c", 1, 3)]
    a, b, c = (F.col(x) for x in "abc")
    return simulate.solve_exact(spark, v, a * b - c * c + b).select("a", "b", "c", "objective")


PATHS = """p AS (SELECT CAST([] AS BIGINT[]) AS trades, CAST([] AS BIGINT[]) AS inventories, CAST(0 AS BIGINT) AS inv UNION ALL
  SELECT list_append(trades, t), list_append(inventories, inv + t), inv + t FROM p, (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS t) WHERE len(trades) < 4 AND inv + t BETWEEN -2 AND 2)"""


@C.add(
    "combinatorial__trading_paths",
    f"""WITH RECURSIVE {PATHS}
SELECT array_to_string(trades, ',') AS trades, array_to_string(inventories, ',') AS inventories FROM p WHERE len(trades) = 4 AND inv = 0""",
)
def paths(spark, d):
    got = simulate.trading_paths(spark, 4, (-1, 1), (-2, 2), terminal=0)
    return got.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("trades", "inventories")])


@C.add(
    "combinatorial__trajectory",
    f"""WITH RECURSIVE {PATHS}, o AS (SELECT trades, list_sum(list_transform(inventories, lambda v, i: v * ([0.01e0, -0.02e0, 0.03e0, 0.01e0])[i] - 0.001e0 * v * v - 0.001e0 * abs(trades[i])
  - CASE WHEN trades[i] <> 0 THEN 0.0005e0 ELSE 0 END)) - 0.1e0 * abs(inv) AS objective FROM p WHERE len(trades) = 4 AND inv = 0)
SELECT array_to_string(trades, ',') AS trades, {r('objective')} AS objective FROM o ORDER BY o.objective DESC, o.trades LIMIT 1""",
)
def trajectory(spark, d):
    got = simulate.trading_paths(spark, 4, (-1, 1), (-2, 2), terminal=0)
    best = simulate.solve_trajectory(got, simulate.path_objective([0.01, -0.02, 0.03, 0.01], risk=0.001, impact=0.001, ticket=0.0005, terminal=0.1))
    return rounded(best.select(F.array_join(F.col("trades").cast("array<string>"), ",").alias("trades"), "objective"), "objective")


@C.add("ef3m__fit")
def ef3m(spark, d):
    moments = simulate.raw_moments(-2.0, 1.0, 2.0, 1.0, 0.1)
    return simulate.fit_mixture(spark, moments, 4, epsilon=1e-3)


@C.add("hpc__run_parallel", "SELECT CAST(i AS INT) AS part, CAST(sum(x) AS DOUBLE) AS value FROM (SELECT x, x // 25 AS i FROM range(100) t(x)) GROUP BY 1")
def parallel(spark, d):
    values = simulate.run_parallel(spark, list(range(100)), lambda xs: sum(xs), parts=4)
    return spark.createDataFrame(list(enumerate(values)), "part int, value double")


# Streaming


def warning_events(spark, d):
    t = domain.ticks(spark, d)
    buy = F.when(F.col("user_id") % 3 == 0, 0.8).otherwise(0.3)
    return t.select(F.col("symbol").alias("stream"), "ord", "price", (F.col("volume") * buy).alias("buy_volume"), (F.col("volume") * (1 - buy)).alias("sell_volume"), (F.col("user_id") % 8).alias("venue"))


CONFIG = early_warning.WarningConfig(50.0, 10, 50, 0.35, 0.13)


#: Buckets are cut where the running volume passes multiples of 50 (volumes are whole); an event of 10 or less is in two at
#: most.
REPLAY = f"""{TICKS}, e AS (SELECT symbol AS stream, ord, CAST(volume AS BIGINT) AS v, CASE WHEN user_id % 3 = 0 THEN 0.6e0 ELSE 0.4e0 END AS g, user_id % 8 AS venue FROM ticks WHERE price > 0),
cum AS (SELECT *, row_number() OVER w AS n, CAST(sum(v) OVER w AS BIGINT) AS t, list(venue) OVER (PARTITION BY stream ORDER BY ord ROWS 49 PRECEDING) AS last FROM e WINDOW w AS (PARTITION BY stream ORDER BY ord)),
piece AS (SELECT stream, t, v, g, unnest(range((t - v) // 50, (t - 1) // 50 + 1)) AS k FROM cum),
b AS (SELECT stream, k, sum((least(t, 50 * k + 50) - greatest(t - v, 50 * k)) * g) / 50 AS value, sum(least(t, 50 * k + 50) - greatest(t - v, 50 * k)) AS filled FROM piece GROUP BY 1, 2),
w AS (SELECT stream, k, avg(value) OVER (PARTITION BY stream ORDER BY k ROWS 9 PRECEDING) AS vpin FROM b WHERE filled = 50),
s AS (SELECT c.stream, c.ord, w.vpin, CASE WHEN n >= 50 THEN list_sum(list_transform(range(8), lambda x: pow(len(list_filter(last, lambda y: y = x)), 2))) / 2500 END AS hhi
  FROM cum c LEFT JOIN w ON w.stream = c.stream AND w.k = c.t // 50 - 1 AND w.k >= 9),
snap AS (SELECT *, 0.5 * (vpin / 0.35 + hhi / 0.13) AS score, coalesce(vpin >= 0.35 AND hhi >= 0.13, false) AS alert FROM s)"""


@C.add("streaming__replay", f"WITH {REPLAY} SELECT stream, ord, {r('vpin')} AS vpin, {r('hhi')} AS hhi, {r('score')} AS score, alert FROM snap")
def replay(spark, d):
    return rounded(early_warning.replay(warning_events(spark, d), CONFIG), "vpin", "hhi", "score")


@C.add(
    "streaming__summary",
    f"WITH {REPLAY} SELECT stream, count(*) AS events, count(*) FILTER (alert) AS alerts, {r('arg_max_null(vpin, ord)')} AS vpin, {r('arg_max_null(hhi, ord)')} AS hhi, {r('arg_max_null(score, ord)')} AS score FROM snap GROUP BY 1",
)
def summary(spark, d):
    return rounded(early_warning.summary(early_warning.replay(warning_events(spark, d), CONFIG)), "vpin", "hhi", "score")


@C.add(
    "streaming__synthetic_crash",
    f"""SELECT 'synthetic' AS stream, i AS ord, i * 1000000 AS timestamp_ns, {r('100 * pow(1.0001, least(i + 1, 700)) * pow(0.9975, greatest(i + 1 - 700, 0))')} AS price, CASE WHEN i >= 700 THEN 80e0 ELSE 120e0 END AS buy_volume,
  CASE WHEN i >= 700 THEN 320e0 ELSE 130e0 END AS sell_volume, CASE WHEN i >= 700 THEN 0 ELSE i % 8 END AS venue FROM range(1000) t(i)""",
)
def crash(spark, d):
    return rounded(early_warning.synthetic_crash(spark, 1000), "price")


# Plans


def research_bars(spark, d):
    t = domain.ticks(spark, d)
    return t.select("symbol", "ts", "ord", F.col("price").alias("close"), (0.5 + (F.col("user_id") % 40) / 100.0).alias("prob"), F.when(F.col("ord") % 3 == 0, -1.0).otherwise(1.0).alias("side"))


PIPE = pipeline.PipelineConfig(cusum_threshold=2.0)


@C.add("pipeline__strategy_path")
def strategy(spark, d):
    bars = research_bars(spark, d)
    signals_ = pipeline.event_signals(pipeline.select_events(bars, PIPE), PIPE)
    path = pipeline.strategy_path(pipeline.signal_timeline(bars, signals_))
    return rounded(path.select("symbol", "ord", "position", "ret"), "position", "ret")


@C.add("pipeline__summary")
def pipe_summary(spark, d):
    result = pipeline.run_pipeline(research_bars(spark, d), domain.prices(spark, d), PIPE)
    return result.summary(spark)


@C.add("pipeline__flywheel")
def flywheel(spark, d):
    return pipeline.run_flywheel(*pipeline.synthetic_dataset(spark), pipeline.FlywheelConfig())


@C.add("pipeline__flywheel_grid")
def flywheel_grid(spark, d):
    return pipeline.run_grid(*pipeline.synthetic_dataset(spark, 96), {"base": {}, "wide": {"cusum_threshold": 0.002}})


DD = f"{TICKS}, c AS (SELECT symbol, ts, price AS equity FROM ticks)"


@C.add("viz__drawdown", f"WITH {DD} SELECT symbol, ts, equity, {r('equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM c")
def viz_drawdown(spark, d):
    return rounded(frames.drawdown_curve(domain.ticks(spark, d).select("symbol", "ts", F.col("price").alias("equity"))), "drawdown")


@C.add("viz__top_features", "SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def viz_top(spark, d):
    p = domain.read(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return frames.top_features(p, 5)


@C.add("viz__regime", f"WITH {TICKS} SELECT ord, CASE WHEN price >= 100 THEN 1 ELSE -1 END AS regime FROM ticks")
def viz_regime(spark, d):
    return domain.ticks(spark, d).select("ord", frames.regime("price", 100.0).alias("regime"))


@C.add("frames__indicator", "SELECT CAST(bar AS BIGINT) AS bar_index, max(CAST(label = 'x' AS INT)) AS x, max(CAST(label = 'y' AS INT)) AS y FROM (SELECT event_id % 50 AS bar, CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'y' END AS label FROM events) GROUP BY 1")
def indicator_frame(spark, d):
    e = domain.read(spark, d, "events")
    return frames.indicator_frame(e.select((F.col("event_id") % 50).alias("bar"), F.when(F.col("user_id") % 2 == 0, "x").otherwise("y").alias("label")), ["x", "y"])


QUERIES, ORACLES = C.queries, C.oracles
