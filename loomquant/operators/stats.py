"""Backtest statistics and tail risk as aggregates and windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sharpe import expected_max_sharpe, probabilistic_sharpe_ratio

def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def sharpe_ratio(returns: DataFrame, per_year: float, risk_free: float = 0.0, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """(symbol, sharpe): mean over the risk-free rate by the deviation, annualised."""
    return returns.groupBy(by).agg(F.try_divide(F.avg(value) - risk_free, F.stddev_samp(value)).alias("s")).select(by, (F.col("s") * math.sqrt(per_year)).alias("sharpe"))


def information_ratio(returns: DataFrame, benchmark: float, per_year: float, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """Sharpe ratio of the returns over the benchmark."""
    return sharpe_ratio(returns.withColumn(value, F.col(value) - benchmark), per_year, 0.0, value=value, by=by).withColumnRenamed("sharpe", "information_ratio")


def moments(returns: DataFrame, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """(symbol, n, sharpe, skew, kurtosis): what the probabilistic Sharpe ratio needs; kurtosis is not the excess."""
    return returns.groupBy(by).agg(
        F.count(value).alias("n"),
        F.try_divide(F.avg(value), F.stddev_samp(value)).alias("sharpe"),
        F.skewness(value).alias("skew"),
        (F.kurtosis(value) + 3).alias("kurtosis"),
    )


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    m = moments(returns, value=value, by=by)
    return m.withColumn("psr", probabilistic_sharpe_ratio(F.col("sharpe"), F.lit(benchmark), F.col("n"), F.col("skew"), F.col("kurtosis")))


def deflated_sharpe(returns: DataFrame, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """The probabilistic Sharpe ratio of each symbol against the largest that as many trials as there are symbols would
    reach without skill."""
    m = moments(returns, value=value, by=by)
    one = m.agg(F.stddev_pop("sharpe").alias("std"), F.count("*").alias("k")).first()
    bench = expected_max_sharpe(F.lit(one["std"]), int(one["k"])) if one["k"] and one["k"] > 1 else F.lit(0.0)
    scored = m.withColumn("benchmark", bench)
    return scored.withColumn("dsr", probabilistic_sharpe_ratio(F.col("sharpe"), F.col("benchmark"), F.col("n"), F.col("skew"), F.col("kurtosis")))


def concentration(value: Column) -> Column:
    """Herfindahl concentration of a group's values scaled to [0, 1]; null for two values or fewer or a sum of 0."""
    n, total = F.count(value), F.sum(value)
    h = F.try_divide(F.sum(value * value), total * total)
    return F.when((n > 2) & (total != 0), (h - 1 / n) / (1 - 1 / n))


def bets_concentration(returns: DataFrame, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    return returns.groupBy(by).agg(concentration(F.col(value)).alias("concentration"))


def all_bets_concentration(returns: DataFrame, *, value: str = "ret") -> DataFrame:
    """(symbol, positive, negative, time): of gains, of losses, and of the number of bets by day, empty days included."""
    v = F.col(value)
    sides = returns.groupBy("symbol").agg(concentration(F.when(v >= 0, v)).alias("positive"), concentration(F.when(v < 0, v)).alias("negative"))
    days = returns.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    spine = days.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("symbol", F.explode(F.sequence("lo", "hi")).alias("day"))
    filled = spine.join(days, ["symbol", "day"], "left").select("symbol", F.coalesce("n", F.lit(0.0)).alias("n"))
    return sides.join(filled.groupBy("symbol").agg(concentration(F.col("n")).alias("time")), "symbol")


def drawdown_and_time_under_water(curve: DataFrame, *, value: str = "value", dollars: bool = False) -> DataFrame:
    """(symbol, start, drawdown, years): for each high-water mark with a dip after it, the depth and the time to the next
    such mark, or to the end."""
    top = F.max(value).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    is_new = F.coalesce((F.col(value) > top).cast("int"), F.lit(1))
    marked = curve.select("symbol", "ts", value, is_new.alias("_new"))
    segment = F.sum("_new").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("_seg", segment).groupBy("symbol", "_seg").agg(
        F.min("ts").alias("start"), F.max(value).alias("_high"), F.min(value).alias("_low")
    )
    dips = parts.where(F.col("_low") < F.col("_high"))
    ends = curve.groupBy("symbol").agg(F.max("ts").alias("_end"))
    after = F.lead("start").over(Window.partitionBy("symbol").orderBy("start"))
    depth = F.col("_high") - F.col("_low") if dollars else 1 - F.try_divide(F.col("_low"), F.col("_high"))
    until = dips.withColumn("_next", after).join(ends, "symbol").withColumn("_to", F.coalesce("_next", "_end"))
    micros = F.unix_micros(F.col("_to").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return until.select("symbol", "start", depth.alias("drawdown"), (micros / (365.25 * 86_400 * 1e6)).alias("years"))


def flattening_and_flips(positions: DataFrame, *, value: str = "position") -> DataFrame:
    """(symbol, ts) where a position goes to 0 or changes its sign, and the last row of each symbol."""
    prev, now = F.lag(value).over(by_time()), F.col(value)
    last = F.lead("ts").over(by_time()).isNull()
    marked = positions.select("symbol", "ts", ((now == 0) & (prev != 0)).alias("_f"), (prev * now < 0).alias("_s"), last.alias("_l"))
    return marked.where(F.col("_f") | F.col("_s") | F.col("_l")).select("symbol", "ts").distinct()


def holding_time(seconds: np.ndarray, position: np.ndarray) -> float | None:
    """Mean holding time in days by average entry times, weighted by size; None if nothing was closed."""
    held = weight = entry = 0.0
    days = (seconds - seconds[0]) / 86_400
    for i in range(1, len(position)):
        before, now = position[i - 1], position[i]
        change = now - before
        if change * before >= 0 and now != 0:
            entry = (entry * before + days[i] * change) / now
        if change * before < 0:
            size = abs(before) if now * before < 0 else abs(change)
            held, weight = held + (days[i] - entry) * size, weight + size
            if now * before < 0:
                entry = days[i]
    return held / weight if weight > 0 else None


def average_holding_period(positions: DataFrame, *, value: str = "position") -> DataFrame:
    """(symbol, days)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending")])
        seconds = table["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
        days = holding_time(np.floor(seconds), table[value].to_numpy())
        return pa.table({"symbol": table["symbol"].slice(0, 1), "days": pa.array([days], pa.float64())})

    return positions.select("symbol", "ts", value).groupBy("symbol").applyInArrow(run, "symbol string, days double")


def quantile_higher(df: DataFrame, value: str, q: float, *, by: str = "symbol", name: str = "quantile") -> DataFrame:
    """(symbol, quantile): the value at rank ceil(q (n - 1)) from 0, by one sort of each symbol."""
    if not 0 <= q <= 1:
        raise ValueError("q must be within [0, 1]")
    w = Window.partitionBy(by)
    ranked = df.select(by, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_r") == F.ceil(q * (F.col("_n") - 1)) + 1).select(by, F.col(value).alias(name))


def tail_risk(returns: DataFrame, q: float = 0.05, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """(symbol, value_at_risk, expected_shortfall): the quantile and the mean of the returns below it (null if none)."""
    var = quantile_higher(returns, value, q, by=by, name="value_at_risk")
    joined = returns.join(var, by)
    below = F.avg(F.when(F.col(value) < F.col("value_at_risk"), F.col(value)))
    return joined.groupBy(by, "value_at_risk").agg(below.alias("expected_shortfall"))


def conditional_drawdown_risk(levels: DataFrame, q: float = 0.05, *, value: str = "ret", by: str = "symbol") -> DataFrame:
    """(symbol, cdar): mean of the running maximum drawdowns above their q quantile."""
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    down = levels.select(by, "ts", (F.max(value).over(w) - F.col(value)).alias("_d"))
    worst = down.select(by, F.max("_d").over(w).alias("_w"))
    bound = quantile_higher(worst, "_w", q, by=by, name="_q")
    return worst.join(bound, by).groupBy(by).agg(F.avg(F.when(F.col("_w") > F.col("_q"), F.col("_w"))).alias("cdar"))


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: w' C w of a long covariance (a, b, cov) and weights (asset, weight)."""
    left = weights.select(F.col("asset").alias("a"), F.col("weight").alias("wa"))
    right = weights.select(F.col("asset").alias("b"), F.col("weight").alias("wb"))
    return cov.join(left, "a").join(right, "b").agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("variance"))
