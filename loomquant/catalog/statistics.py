"""Backtest statistics, risk, dependence, structural breaks, scalar algebra."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bet_sizing as bet
from ..functions import sharpe
from ..functions.normal import norm_cdf, norm_cdf_sql, norm_ppf, norm_ppf_sql
from ..operators import breaks, dependence, stats
from ..sources import domain
from .base import OHLCV, TICKS, Catalog, r, rounded

C = Catalog()
RET = f"{OHLCV}, ret AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ohlcv QUALIFY ret IS NOT NULL)"


def returns(spark, d):
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return domain.ohlcv(spark, d).select("symbol", "ts", "close", (F.try_divide(F.col("close"), before) - 1).alias("ret")).where(F.col("ret").isNotNull())


@C.add("stats__sharpe_ratio", f"WITH {RET} SELECT symbol, {r('(avg(ret) - 0.01) / stddev_samp(ret) * sqrt(252)')} AS sharpe FROM ret GROUP BY symbol")
def sharpe_ratio(spark, d):
    return rounded(stats.sharpe_ratio(returns(spark, d), 252, 0.01), "sharpe")


@C.add("stats__information_ratio", f"WITH {RET} SELECT symbol, {r('avg(ret - 0.02) / stddev_samp(ret - 0.02) * sqrt(252)')} AS information_ratio FROM ret GROUP BY symbol")
def information_ratio(spark, d):
    return rounded(stats.information_ratio(returns(spark, d), 0.02, 252), "information_ratio")


MOM = f"{RET}, m0 AS (SELECT symbol, avg(ret) AS mu FROM ret GROUP BY symbol), m AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(pow(ret - mu, 3)) / pow(var_pop(ret), 1.5) AS sk, avg(pow(ret - mu, 4)) / pow(var_pop(ret), 2) AS ku FROM ret JOIN m0 USING (symbol) GROUP BY symbol)"


def psr_sql(benchmark: str) -> str:
    return norm_cdf_sql(f"((sr - {benchmark}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))")


@C.add("stats__probabilistic_sharpe", f"WITH {MOM} SELECT symbol, n, {r('sr')} AS sharpe, {r('sk')} AS skew, {r('ku')} AS kurtosis, {r(psr_sql('0.3e0'))} AS psr FROM m")
def psr(spark, d):
    return rounded(stats.probabilistic_sharpe(returns(spark, d), 0.3), "sharpe", "skew", "kurtosis", "psr")


_Z1, _Z2 = NormalDist().inv_cdf(1 - 1 / 5), NormalDist().inv_cdf(1 - 1 / (5 * math.e))
_EMAX = (1 - sharpe.EULER_GAMMA) * _Z1 + sharpe.EULER_GAMMA * _Z2


@C.add("stats__deflated_sharpe", f"WITH {MOM}, b AS (SELECT stddev_pop(sr) * {_EMAX} AS bench FROM m) SELECT symbol, {r('bench')} AS benchmark, {r(psr_sql('bench'))} AS dsr FROM m, b")
def dsr(spark, d):
    return rounded(stats.deflated_sharpe(returns(spark, d)).select("symbol", "benchmark", "dsr"), "benchmark", "dsr")


@C.add("stats__minimum_track_record_length", f"WITH {MOM} SELECT symbol, {r(f'1 + (1 - sk * sr + (ku - 1) / 4 * sr * sr) * pow({NormalDist().inv_cdf(0.95)} / (sr - 0.1), 2)')} AS min_trl FROM m")
def min_trl(spark, d):
    m = stats.moments(returns(spark, d))
    return rounded(m.select("symbol", sharpe.minimum_track_record_length(F.col("sharpe"), F.lit(0.1), F.col("skew"), F.col("kurtosis")).alias("min_trl")), "min_trl")


def conc_sql(v: str, where: str = "true") -> str:
    n, s, q = (f"{a} FILTER ({where})" for a in ("count(*)", f"sum({v})", f"sum({v} * {v})"))
    return f"CASE WHEN {n} > 2 AND {s} <> 0 THEN ({q} / ({s} * {s}) - 1.0e0 / {n}) / (1 - 1.0e0 / {n}) END"


@C.add("stats__bets_concentration", f"WITH {RET} SELECT symbol, {r(conc_sql('ret'))} AS concentration FROM ret GROUP BY symbol")
def bets(spark, d):
    return rounded(stats.bets_concentration(returns(spark, d)), "concentration")


@C.add(
    "stats__all_bets_concentration",
    f"""WITH {RET}, s AS (SELECT symbol, {conc_sql('ret', 'ret >= 0')} AS positive, {conc_sql('ret', 'ret < 0')} AS negative FROM ret GROUP BY symbol),
sp AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM ret GROUP BY symbol),
dc AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS c FROM ret GROUP BY 1, 2),
f AS (SELECT sp.symbol, coalesce(c, 0) AS c FROM sp LEFT JOIN dc USING (symbol, day)), tm AS (SELECT symbol, {conc_sql('c')} AS time FROM f GROUP BY symbol)
SELECT symbol, {r('positive')} AS positive, {r('negative')} AS negative, {r('time')} AS time FROM s JOIN tm USING (symbol)""",
)
def all_bets(spark, d):
    return rounded(stats.all_bets_concentration(returns(spark, d)), "positive", "negative", "time")


def dd_sql(depth: str) -> str:
    return f"""WITH {OHLCV}, a AS (SELECT symbol, ts, close, coalesce(close > max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nw FROM ohlcv),
b AS (SELECT *, sum(nw::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM a),
g AS (SELECT symbol, seg, min(ts) AS start, max(close) AS hi, min(close) AS lo FROM b GROUP BY 1, 2 HAVING min(close) < max(close)),
e AS (SELECT symbol, max(ts) AS fin FROM ohlcv GROUP BY symbol)
SELECT symbol, start, {r(depth)} AS drawdown, {r("(epoch_us(coalesce(lead(start) OVER (PARTITION BY symbol ORDER BY start), fin)) - epoch_us(start)) / (365.25 * 86400 * 1e6)")} AS years FROM g JOIN e USING (symbol)"""


def curve(spark, d):
    return domain.ohlcv(spark, d).select("symbol", "ts", F.col("close").alias("value"))


@C.add("stats__drawdown", dd_sql("1 - lo / hi"))
def drawdown(spark, d):
    return rounded(stats.drawdown_and_time_under_water(curve(spark, d)), "drawdown", "years")


@C.add("stats__drawdown_dollars", dd_sql("hi - lo"))
def drawdown_dollars(spark, d):
    return rounded(stats.drawdown_and_time_under_water(curve(spark, d), dollars=True), "drawdown", "years")


POS = f"{TICKS}, pos AS (SELECT symbol, ts, CAST(user_id % 5 - 2 AS DOUBLE) AS position FROM ticks)"


def positions(spark, d):
    return domain.ticks(spark, d).select("symbol", "ts", (F.col("user_id") % 5 - 2).cast("double").alias("position"))


@C.add(
    "stats__flattening_and_flips",
    f"""WITH {POS}, x AS (SELECT symbol, ts, position AS p, lag(position) OVER w AS q, lead(ts) OVER w AS nx FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT DISTINCT symbol, ts FROM x WHERE (p = 0 AND q <> 0) OR p * q < 0 OR nx IS NULL""",
)
def flips(spark, d):
    return stats.flattening_and_flips(positions(spark, d))


@C.add(
    "stats__average_holding_period",
    f"""WITH RECURSIVE {POS}, n AS (SELECT symbol, position AS p, floor(epoch_us(ts) / 1e6) AS s, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM pos),
t AS (SELECT symbol, p, rn, (s - min(s) OVER (PARTITION BY symbol)) / 86400.0e0 AS t FROM n),
k AS (SELECT symbol, rn, p, 0e0 AS entry, 0e0 AS hold, 0e0 AS wt FROM t WHERE rn = 1 UNION ALL
  SELECT symbol, rn, p, CASE WHEN d * q < 0 AND p * q < 0 THEN t WHEN d * q >= 0 AND p <> 0 THEN (entry * q + t * d) / p ELSE entry END,
    CASE WHEN d * q < 0 THEN t - entry ELSE 0 END, CASE WHEN d * q < 0 THEN CASE WHEN p * q < 0 THEN abs(q) ELSE abs(d) END ELSE 0 END
  FROM (SELECT t.symbol, t.rn, t.p, k.p AS q, t.p - k.p AS d, t.t, k.entry FROM k JOIN t ON t.symbol = k.symbol AND t.rn = k.rn + 1))
SELECT symbol, {r('sum(hold * wt) / nullif(sum(wt), 0)')} AS days FROM k GROUP BY symbol""",
)
def holding(spark, d):
    return rounded(stats.average_holding_period(positions(spark, d)), "days")


VAR = f"{RET}, q AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ret), v AS (SELECT symbol, ret AS var FROM q WHERE rn = ceil(0.05 * (n - 1)) + 1)"


@C.add("risk__var_es", f"WITH {VAR} SELECT symbol, {r('any_value(var)')} AS value_at_risk, {r('avg(ret) FILTER (ret < var)')} AS expected_shortfall FROM ret JOIN v USING (symbol) GROUP BY symbol")
def var_es(spark, d):
    return rounded(stats.tail_risk(returns(spark, d), 0.05), "value_at_risk", "expected_shortfall")


@C.add(
    "risk__conditional_drawdown",
    f"""WITH {OHLCV}, a AS (SELECT symbol, ts, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - close AS d FROM ohlcv),
b AS (SELECT symbol, max(d) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS w FROM a), c AS (SELECT symbol, w, row_number() OVER (PARTITION BY symbol ORDER BY w) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM b),
q AS (SELECT symbol, w AS bound FROM c WHERE rn = ceil(0.05 * (n - 1)) + 1) SELECT symbol, {r('avg(w) FILTER (w > bound)')} AS cdar FROM b JOIN q USING (symbol) GROUP BY symbol""",
)
def cdar(spark, d):
    return rounded(stats.conditional_drawdown_risk(curve(spark, d), 0.05, value="value"), "cdar")


FEAT = "f AS (SELECT l_returnflag AS symbol, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


def features(spark, d):
    return domain.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@C.add("codependence__angular", f"WITH {FEAT}, c AS (SELECT symbol, corr(x, y) AS r FROM f GROUP BY symbol) SELECT symbol, {r('sqrt(0.5 * (1 - r))')} AS angular, {r('sqrt(0.5 * (1 - abs(r)))')} AS absolute_angular, {r('sqrt(0.5 * (1 - r * r))')} AS squared_angular FROM c")
def angular(spark, d):
    return rounded(dependence.angular_distances(features(spark, d), "x", "y"), "angular", "absolute_angular", "squared_angular")


def tick_pairs(spark, d):
    return domain.ticks(spark, d).select("symbol", F.col("price").alias("x"), F.col("volume").alias("y"))


@C.add(
    "codependence__distance_correlation",
    f"""WITH {TICKS}, f AS (SELECT symbol, ord, price AS x, volume AS y FROM ticks),
p AS (SELECT a.symbol, a.ord AS i, b.ord AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM f a JOIN f b USING (symbol)),
c AS (SELECT symbol, dx - avg(dx) OVER (PARTITION BY symbol, i) - avg(dx) OVER (PARTITION BY symbol, j) + avg(dx) OVER (PARTITION BY symbol) AS a,
  dy - avg(dy) OVER (PARTITION BY symbol, i) - avg(dy) OVER (PARTITION BY symbol, j) + avg(dy) OVER (PARTITION BY symbol) AS b FROM p)
SELECT symbol, {r('sqrt(avg(a * b)) / sqrt(sqrt(avg(a * a) * avg(b * b)))')} AS distance_correlation FROM c GROUP BY symbol""",
)
def dcor(spark, d):
    return rounded(dependence.distance_correlation(tick_pairs(spark, d), "x", "y"), "distance_correlation")


BINNED = f"""{FEAT}, e AS (SELECT *, min(x) OVER s AS lx, max(x) OVER s AS hx, min(y) OVER s AS ly, max(y) OVER s AS hy FROM f WINDOW s AS (PARTITION BY symbol)),
b AS (SELECT symbol, CAST(least(floor((x - lx) / ((hx - lx) / 10)), 9) AS BIGINT) AS bin_x, CAST(least(floor((y - ly) / ((hy - ly) / 10)), 9) AS BIGINT) AS bin_y FROM e),
h AS (SELECT symbol, bin_x, bin_y, count(*) AS count FROM b GROUP BY ALL)"""


@C.add("codependence__histogram2d", f"WITH {BINNED} SELECT symbol, bin_x, bin_y, count FROM h")
def hist(spark, d):
    return dependence.histogram2d(features(spark, d), "x", "y", 10)


@C.add(
    "codependence__information",
    f"""WITH {BINNED}, p AS (SELECT symbol, bin_x, bin_y, count / sum(count) OVER (PARTITION BY symbol) AS p FROM h),
m AS (SELECT *, sum(p) OVER (PARTITION BY symbol, bin_x) AS px, sum(p) OVER (PARTITION BY symbol, bin_y) AS py FROM p),
j AS (SELECT symbol, sum(p * ln(p / (px * py))) AS mi, -sum(p * ln(p)) AS hxy, -sum(p * ln(px)) AS hx, -sum(p * ln(py)) AS hy FROM m GROUP BY symbol)
SELECT symbol, {r('mi')} AS mutual_info, {r('mi / least(hx, hy)')} AS normalized_mutual_info, {r('hx + hy - 2 * mi')} AS variation, {r('(hx + hy - 2 * mi) / hxy')} AS normalized_variation FROM j""",
)
def info(spark, d):
    found = dependence.information(features(spark, d), "x", "y", 10)
    return rounded(found, "mutual_info", "normalized_mutual_info", "variation", "normalized_variation")


LOGP = f"{OHLCV}, lp AS (SELECT symbol, ts, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM ohlcv)"


def log_prices(spark, d):
    return domain.ohlcv(spark, d).select("symbol", "ts", F.ln("close").alias("log_price"))


@C.add(
    "breaks__chow",
    f"""WITH {LOGP}, z AS (SELECT symbol, i, lag(y) OVER w AS x, y - lag(y) OVER w AS d FROM lp WINDOW w AS (PARTITION BY symbol ORDER BY i)),
k AS (SELECT symbol, count(*) AS m, sum(d * d) AS syy FROM z WHERE i > 0 GROUP BY symbol),
s AS (SELECT b.symbol, b.i AS brk, k.m, k.syy, sum(z.x * z.d) AS sxy, sum(z.x * z.x) AS sxx FROM lp b JOIN z ON z.symbol = b.symbol AND z.i > b.i JOIN k ON k.symbol = b.symbol GROUP BY 1, 2, 3, 4)
SELECT symbol, brk AS "break", {r('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (m - 1) / sxx)', 5)} AS stat FROM s WHERE brk >= 20 AND brk < m + 1 - 20""",
)
def chow(spark, d):
    return rounded(breaks.chow_type_stat(log_prices(spark, d), 20), "stat", digits=5)


def csw_sql(gap: str) -> str:
    return f"""WITH {LOGP}, v AS (SELECT symbol, i, y, sum(pow(dy, 2)) OVER (PARTITION BY symbol ORDER BY i) AS s FROM (SELECT *, y - lag(y) OVER (PARTITION BY symbol ORDER BY i) AS dy FROM lp)),
p AS (SELECT t.symbol, t.i, t.i - o.i AS dist, {gap} / (t.s / (t.i - 1) * sqrt(t.i - o.i)) AS st FROM v t JOIN lp o ON o.symbol = t.symbol AND o.i < t.i WHERE t.i >= 2)
SELECT symbol, i, {r('max(st)', 5)} AS stat, {r('sqrt(4.6 + ln(arg_max(dist, st)))')} AS critical_value FROM p GROUP BY 1, 2"""


@C.add("breaks__csw_one_sided", csw_sql("(t.y - o.y)"))
def csw_one(spark, d):
    return rounded(rounded(breaks.chu_stinchcombe_white(log_prices(spark, d)), "stat", digits=5), "critical_value")


@C.add("breaks__csw_two_sided", csw_sql("abs(t.y - o.y)"))
def csw_two(spark, d):
    return rounded(rounded(breaks.chu_stinchcombe_white(log_prices(spark, d), "two_sided"), "stat", digits=5), "critical_value")


SADF_EXP = f"""WITH {OHLCV}, a AS (SELECT symbol, ln(close) AS lp, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM ohlcv),
z AS (SELECT symbol, idx - 3 AS i, CAST(idx - 3 AS DOUBLE) AS x, ln(lp) AS y FROM a WHERE idx >= 3),
c AS (SELECT symbol, i, x, y, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy, sum(y * y) OVER w AS syy FROM z WINDOW w AS (PARTITION BY symbol ORDER BY i)),
q AS (SELECT e.symbol, e.i, CAST(e.i + 1 - s.i AS DOUBLE) AS n, e.sx - s.sx + s.x AS sx, e.sy - s.sy + s.y AS sy, e.sxx - s.sxx + s.x * s.x AS sxx, e.sxy - s.sxy + s.x * s.y AS sxy, e.syy - s.syy + s.y * s.y AS syy
  FROM c e JOIN c s ON s.symbol = e.symbol AND s.i <= e.i + 1 - 30 WHERE e.i >= 30),
t AS (SELECT symbol, i, n, sxx - sx * sx / n AS vx, sxy - sx * sy / n AS vxy, syy - sy * sy / n AS vy FROM q)
SELECT symbol, i, {r('max((vxy / vx) / sqrt((vy - vxy * vxy / vx) / (n - 2) / vx))', 3)} AS sadf FROM t GROUP BY symbol, i"""


def register_sadf(model: str):
    @C.add(f"breaks__sadf_{model}", SADF_EXP if model == "sm_exp" else None)
    def query(spark, d):
        return rounded(breaks.sadf(log_prices(spark, d), model, lags=2, min_length=30), "sadf", digits=3)


for _model in breaks.MODELS:
    register_sadf(_model)


@C.add("functions__norm_cdf", f"WITH x AS (SELECT event_id, (value - 250) / 60 AS z FROM events) SELECT event_id, {r(norm_cdf_sql('z'), 9)} AS p FROM x")
def cdf(spark, d):
    e = domain.read(spark, d, "events").select("event_id", ((F.col("value") - 250) / 60).alias("z"))
    return rounded(e.select("event_id", norm_cdf(F.col("z")).alias("p")), "p", digits=9)


@C.add("functions__norm_ppf", f"WITH x AS (SELECT event_id, (event_id % 997 + 1) / 999.0e0 AS p FROM events) SELECT event_id, {r(norm_ppf_sql('p'))} AS z FROM x")
def ppf(spark, d):
    e = domain.read(spark, d, "events").select("event_id", ((F.col("event_id") % 997 + 1) / 999.0).alias("p"))
    return rounded(e.select("event_id", norm_ppf("p").alias("z")), "z")


BETS = "b AS (SELECT event_id, 0.02e0 + (user_id % 97) / 100.0e0 AS p, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS s, value AS f, value * (0.9 + (user_id % 21) / 100.0e0) AS m, CAST(user_id % 40 - 20 AS DOUBLE) AS pos, 55e0 AS mx FROM events)"


def bets_frame(spark, d):
    u, v = F.col("user_id"), F.col("value")
    return domain.read(spark, d, "events").select(
        "event_id", (0.02 + (u % 97) / 100.0).alias("p"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("s"),
        v.alias("f"), (v * (0.9 + (u % 21) / 100.0)).alias("m"), (u % 40 - 20).cast("double").alias("pos"), F.lit(55.0).alias("mx"),
    )


SIGNAL = f"(s * (2 * {norm_cdf_sql('((p - 0.5) / sqrt(p * (1 - p)))')} - 1))"


@C.add("bet_sizing__signal", f"WITH {BETS} SELECT event_id, {r(SIGNAL)} AS signal, {r(f'greatest(-1e0, least(1e0, round({SIGNAL} / 0.1e0) * 0.1e0))')} AS discrete FROM b")
def signal(spark, d):
    b = bets_frame(spark, d).withColumn("signal", bet.get_signal(F.col("p"), 2, F.col("s")))
    return rounded(b.select("event_id", "signal", bet.discrete_signal(F.col("signal"), 0.1).alias("discrete")), "signal", "discrete")


_WD = bet.dynamic_width()


@C.add(
    "bet_sizing__dynamic",
    f"""WITH {BETS}, t AS (SELECT *, (f - m) / sqrt({_WD} + (f - m) * (f - m)) AS bet, trunc((f - m) / sqrt({_WD} + (f - m) * (f - m)) * mx) AS tp FROM b),
u AS (SELECT *, CAST(abs(pos + CASE WHEN tp >= pos THEN 1 ELSE -1 END) AS BIGINT) AS a, CAST(abs(tp) AS BIGINT) AS z FROM t)
SELECT event_id, {r('bet')} AS bet, {r('tp')} AS target, {r(f"CASE WHEN tp <> pos THEN coalesce(list_sum(list_transform(range(a, z + 1), lambda j: f - (j / mx) * sqrt({_WD} / (1 - (j / mx) * (j / mx))))), 0) / abs(tp - pos) END")} AS price FROM u""",
)
def dynamic(spark, d):
    b = bets_frame(spark, d)
    size, target, price = bet.bet_size_dynamic(F.col("pos"), F.col("mx"), F.col("m"), F.col("f"))
    return rounded(b.select("event_id", size.alias("bet"), target.alias("target"), price.alias("price")), "bet", "target", "price")


@C.add(
    "bet_sizing__power",
    f"""WITH {BETS}, x AS (SELECT event_id, s * p AS x, p FROM b)
SELECT event_id, {r('sign(x) * pow(abs(x), 2)')} AS size, {r('10 - sign(x) * pow(abs(x), 0.5)')} AS price, {r('greatest(0e0, ln(0.5e0) / ln(p))')} AS w FROM x WHERE p < 0.999""",
)
def power(spark, d):
    b = bets_frame(spark, d).where("p < 0.999").select("event_id", (F.col("s") * F.col("p")).alias("x"), "p", "s")
    x = F.col("x")
    return rounded(
        b.select("event_id", bet.bet_size(2.0, x, "power").alias("size"), bet.inv_price(10.0, 2.0, x, "power").alias("price"), bet.get_w(x, 0.5 * F.col("s"), "power").alias("w")),
        "size", "price", "w",
    )


@C.add(
    "strategy_risk__algebra",
    f"""WITH b AS (SELECT event_id, 0.51e0 + (user_id % 40) / 100.0e0 AS p, 50e0 + user_id % 300 AS n, 0.5e0 + (event_id % 20) / 10.0e0 AS t FROM events)
SELECT event_id, {r('(2 * p - 1) / (2 * sqrt(p * (1 - p))) * sqrt(n)')} AS sharpe, {r('0.5 * (1 + t / sqrt(t * t + n))')} AS precision_needed, {r('4 * t * t * p * (1 - p) / pow(2 * p - 1, 2)')} AS frequency_needed,
  {r('((0.005e0 + 0.004e0) * p - 0.004e0) / (0.009e0 * sqrt(p * (1 - p))) * sqrt(n)')} AS asymmetric, {r('t * t * 0.009e0 * 0.009e0 * p * (1 - p) / pow(0.009e0 * p - 0.004e0, 2)')} AS asymmetric_frequency FROM b""",
)
def algebra(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    b = domain.read(spark, d, "events").select("event_id", (0.51 + (u % 40) / 100.0).alias("p"), (50.0 + u % 300).alias("n"), (0.5 + (e % 20) / 10.0).alias("t"))
    p, n, t, win, loss = F.col("p"), F.col("n"), F.col("t"), F.lit(0.005), F.lit(-0.004)
    out = b.select(
        "event_id", sharpe.sharpe_symmetric(p, n).alias("sharpe"), sharpe.implied_precision_symmetric(t, n).alias("precision_needed"),
        sharpe.implied_frequency_symmetric(p, t).alias("frequency_needed"), sharpe.sharpe_asymmetric(p, n, win, loss).alias("asymmetric"),
        sharpe.implied_frequency_asymmetric(p, t, win, loss).alias("asymmetric_frequency"),
    )
    return rounded(out, "sharpe", "precision_needed", "frequency_needed", "asymmetric", "asymmetric_frequency")


@C.add("strategy_risk__precision_round_trip", "SELECT event_id, true AS reached FROM events")
def round_trip(spark, d):
    """The precision that is implied for a Sharpe ratio gives this ratio again."""
    u, e = F.col("user_id"), F.col("event_id")
    b = domain.read(spark, d, "events").select("event_id", (50.0 + u % 300).alias("n"), (0.5 + (e % 20) / 10.0).alias("t"))
    win, loss = F.lit(0.005), F.lit(-0.01)
    p = sharpe.implied_precision_asymmetric(F.col("t"), F.col("n"), win, loss)
    back = b.withColumn("p", p).withColumn("back", sharpe.sharpe_asymmetric(F.col("p"), F.col("n"), win, loss))
    return back.select("event_id", (F.abs(F.col("back") - F.col("t")) < 1e-6).alias("reached"))


QUERIES, ORACLES = C.queries, C.oracles
