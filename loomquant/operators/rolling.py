"""Rolling features by window frames: volatility, microstructure, fractional differences. Every function takes bars with
`symbol` and `ts` and adds one column, null until its window is full."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import norm_cdf
from .ordered import add_columns, scan

def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def frame(window: int):
    if window < 1:
        raise ValueError("the window must hold a row")
    return by_time().rowsBetween(1 - window, 0)


def full(value: Column, aggregate, window: int) -> Column:
    """`aggregate(value)` over the last `window` rows, null unless all of them have a value."""
    w = frame(window)
    return F.when(F.count(value).over(w) == window, aggregate(value).over(w))


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_time())


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def parkinson_vol(df: DataFrame, window: int, name: str = "parkinson") -> DataFrame:
    square = F.pow(F.ln(F.try_divide(F.col("high"), F.col("low"))), 2)
    return df.withColumn(name, F.sqrt(full(square, F.avg, window) / (4 * math.log(2))))


def garman_klass_vol(df: DataFrame, window: int, name: str = "garman_klass") -> DataFrame:
    range_part = 0.5 * F.pow(F.ln(F.try_divide(F.col("high"), F.col("low"))), 2)
    body = (2 * math.log(2) - 1) * F.pow(F.ln(F.try_divide(F.col("close"), F.col("open"))), 2)
    return df.withColumn(name, F.sqrt(full(range_part - body, F.avg, window)))


def yang_zhang_vol(df: DataFrame, window: int, name: str = "yang_zhang") -> DataFrame:
    """The close component uses the previous open."""
    if window < 2:
        return df.withColumn(name, F.lit(None).cast("double"))
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    parts = df.select(
        "*",
        F.pow(F.ln(F.try_divide(o, lag("close"))), 2).alias("_a"),
        F.pow(F.ln(F.try_divide(c, lag("open"))), 2).alias("_b"),
        (F.ln(F.try_divide(h, c)) * F.ln(F.try_divide(h, o)) + F.ln(F.try_divide(low, c)) * F.ln(F.try_divide(low, o))).alias("_r"),
    )
    total = full(F.col("_a"), F.sum, window) + k * full(F.col("_b"), F.sum, window) + (1 - k) * full(F.col("_r"), F.sum, window)
    return parts.withColumn(name, F.sqrt(total / (window - 1))).drop("_a", "_b", "_r")


class Ewma:
    """Weighted means with weights (1 - alpha)^k over all rows so far, alpha = 2 / (window + 1)."""

    def __init__(self, window: int):
        self.decay = 1 - 2 / (window + 1)
        self.total = self.weight = 0.0

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(values))
        for i, x in enumerate(values.tolist()):
            self.total, self.weight = x + self.decay * self.total, 1 + self.decay * self.weight
            out[i] = self.total / self.weight
        return out


class EwStd:
    """Exponentially weighted deviation that starts at 0 with the first value."""

    def __init__(self, span: int):
        self.alpha = 2 / (span + 1)
        self.mean: float | None = None
        self.variance = 0.0

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(values))
        for i, r in enumerate(values.tolist()):
            if self.mean is None:
                self.mean = r
            else:
                delta = r - self.mean
                self.mean += self.alpha * delta
                self.variance = (1 - self.alpha) * (self.variance + self.alpha * delta * delta)
            out[i] = math.sqrt(self.variance)
        return out


def _scanned(df: DataFrame, value: str, name: str, start) -> DataFrame:
    def kernel():
        state = start()
        return lambda c: {name: state(c[value])}

    return scan(df, kernel, {name: T.DoubleType()}, by=["symbol"], order=["ts"])


def ewma(df: DataFrame, value: str, window: int, name: str = "ewma") -> DataFrame:
    return _scanned(df, value, name, lambda: Ewma(window))


def daily_vol(df: DataFrame, lookback: int, name: str = "daily_vol") -> DataFrame:
    """Deviation of the returns against the last close a day or more ago; rows without such a close drop out."""
    stamped = df.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    day_old = Window.partitionBy("symbol").orderBy("_us").rangeBetween(Window.unboundedPreceding, -86_400_000_000)
    with_ret = stamped.withColumn("_ret", F.try_divide(F.col("close"), F.last("close").over(day_old)) - 1).where(F.col("_ret").isNotNull())
    return _scanned(with_ret, "_ret", name, lambda: EwStd(lookback)).drop("_us", "_ret")


def fracdiff_weights(d: float, size: int) -> list[float]:
    """Weights of the last `size` values, oldest first."""
    w = [1.0]
    for k in range(1, size):
        w.append(-w[-1] * (d - k + 1) / k)
    return w[::-1]


def fracdiff_weights_ffd(d: float, threshold: float, limit: int) -> list[float]:
    """Weights down to the first one below the threshold, oldest first."""
    w = [1.0]
    for k in range(1, limit):
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w[::-1]


def frac_diff_ffd(df: DataFrame, value: str, d: float, threshold: float = 1e-5, limit: int = 1000, name: str = "ffd") -> DataFrame:
    """Fixed-width fractional difference: a sum of lags, which stays in whole-stage code; null in the first width rows."""
    w = fracdiff_weights_ffd(d, threshold, limit)
    width = len(w) - 1
    values = F.collect_list(F.col(value)).over(by_time().rowsBetween(-width, 0))
    weights = F.array(*map(F.lit, w))
    dot = F.aggregate(F.zip_with("_v", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    held = df.select("*", values.alias("_v"))
    return held.withColumn(name, F.when(F.size("_v") == width + 1, dot)).drop("_v")


def frac_diff_values(series: np.ndarray, d: float, threshold: float) -> np.ndarray:
    """Expanding fractional difference by one convolution; NaN while the missing weights exceed the threshold."""
    n = len(series)
    oldest_first = np.array(fracdiff_weights(d, n))
    w = oldest_first[::-1]
    skip = int((np.cumsum(np.abs(oldest_first)) / np.abs(w).sum() > threshold).sum())
    size = 1 << (2 * n - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(series, size) * np.fft.rfft(w, size), size)[:n]
    out[: min(skip, n)] = np.nan
    return out


def frac_diff(df: DataFrame, value: str, d: float, threshold: float = 0.01, name: str = "fracdiff") -> DataFrame:
    return add_columns(df, lambda c: {name: frac_diff_values(c[value], d, threshold)}, {name: T.DoubleType()}, by=["symbol"], order=["ts"])


def _covariance(x: str, y: str, window: int) -> Column:
    w = frame(window)
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w)
    return F.when(both == window, F.covar_samp(x, y).over(w))


def roll_measure(df: DataFrame, window: int, name: str = "roll") -> DataFrame:
    """Effective spread from the autocovariance of price changes."""
    moved = df.withColumn("_d", F.col("close") - lag("close")).withColumn("_d1", lag("_d"))
    return moved.withColumn(name, 2 * F.sqrt(F.abs(_covariance("_d", "_d1", window)))).drop("_d", "_d1")


def roll_impact(df: DataFrame, window: int, name: str = "roll_impact") -> DataFrame:
    return roll_measure(df, window, "_roll").withColumn(name, ratio(F.col("_roll"), F.col("dollar_volume"))).drop("_roll")


_K = 3 - 2 * math.sqrt(2)


def _with_beta_gamma(df: DataFrame, window: int) -> DataFrame:
    two = by_time().rowsBetween(-1, 0)
    square = F.pow(F.ln(F.try_divide(F.col("high"), F.col("low"))), 2)
    with_square = df.withColumn("_hl", square).withColumn("_b", F.col("_hl") + lag("_hl"))
    enough = F.count("*").over(two) == 2
    gamma = F.when(enough, F.pow(F.ln(F.try_divide(F.max("high").over(two), F.min("low").over(two))), 2))
    return with_square.select("*", full(F.col("_b"), F.avg, window).alias("_beta"), gamma.alias("_gamma"))


def corwin_schultz(df: DataFrame, window: int, name: str = "corwin_schultz") -> DataFrame:
    """Bid-ask spread from highs and lows."""
    b, g = F.col("_beta"), F.col("_gamma")
    alpha = F.greatest(F.lit(0.0), (math.sqrt(2) - 1) * F.sqrt(b) / _K - F.sqrt(g / _K))
    a = F.when(b.isNotNull() & g.isNotNull(), alpha)
    spread = 2 * (F.exp(a) - 1) / (1 + F.exp(a))
    return _with_beta_gamma(df, window).withColumn(name, spread).drop("_hl", "_b", "_beta", "_gamma")


def becker_parkinson_vol(df: DataFrame, window: int, name: str = "becker_parkinson") -> DataFrame:
    b, g = F.col("_beta"), F.col("_gamma")
    k2 = math.sqrt(8 / math.pi)
    sigma = (1 / math.sqrt(2) - 1) * F.sqrt(b) / (k2 * _K) + F.sqrt(g / (k2 * k2 * _K))
    value = F.when(b.isNotNull() & g.isNotNull(), F.greatest(F.lit(0.0), sigma))
    return _with_beta_gamma(df, window).withColumn(name, value).drop("_hl", "_b", "_beta", "_gamma")


def bar_kyle_lambda(df: DataFrame, window: int, name: str = "kyle") -> DataFrame:
    """Rolling mean of the price change over signed volume."""
    change = F.col("close") - lag("close")
    moved = df.withColumn("_d", change)
    signed = F.when(F.col("_d") == 0, 0.0).otherwise(ratio(F.col("_d"), F.col("volume") * F.signum("_d")))
    return moved.withColumn("_x", signed).withColumn(name, full(F.col("_x"), F.avg, window)).drop("_d", "_x")


def bar_amihud_lambda(df: DataFrame, window: int, name: str = "amihud") -> DataFrame:
    """Rolling mean of absolute log returns over dollar volume; bars without volume add nothing."""
    moved = df.withColumn("_r", F.abs(F.ln(F.try_divide(F.col("close"), lag("close")))))
    each = F.when(F.col("_r").isNotNull(), F.coalesce(ratio(F.col("_r"), F.col("dollar_volume")), F.lit(0.0)))
    return moved.withColumn("_x", each).withColumn(name, full(F.col("_x"), F.sum, window) / window).drop("_r", "_x")


def bar_hasbrouck_lambda(df: DataFrame, window: int, name: str = "hasbrouck") -> DataFrame:
    moved = df.withColumn("_r", F.ln(F.try_divide(F.col("close"), lag("close"))))
    signed = F.signum("_r") * F.sqrt("dollar_volume")
    each = F.when(F.col("_r").isNotNull(), F.coalesce(ratio(F.col("_r"), signed), F.lit(0.0)))
    return moved.withColumn("_x", each).withColumn(name, full(F.col("_x"), F.sum, window) / window).drop("_r", "_x")


def vpin(df: DataFrame, window: int, name: str = "vpin") -> DataFrame:
    """Rolling mean of |buy - sell| over the current bar's volume."""
    imbalance = df.withColumn("_i", F.abs(2 * F.col("buy_volume") - F.col("volume")))
    return imbalance.withColumn(name, ratio(full(F.col("_i"), F.avg, window), F.col("volume"))).drop("_i")


def bvc_buy_volume(df: DataFrame, window: int, name: str = "buy_volume") -> DataFrame:
    """Bulk volume classification."""
    moved = df.withColumn("_d", F.col("close") - lag("close"))
    std = full(F.col("_d"), F.stddev_samp, window)
    return moved.withColumn("_s", std).withColumn(name, F.col("volume") * norm_cdf(F.col("_d") / F.greatest("_s", F.lit(1e-12)))).withColumn(name, F.when(F.col("_s").isNotNull(), F.col(name))).drop("_d", "_s")


def trade_lambdas(trades: DataFrame) -> DataFrame:
    """One row for each symbol: Kyle, Amihud and Hasbrouck coefficients through the origin, VWAP and mean tick size, of
    trades (price_diff, log_ret, volume, dollar_volume, aggressor)."""
    x, dv = F.col("volume") * F.col("aggressor"), F.col("dollar_volume")
    h = F.sqrt(dv) * F.col("aggressor")
    r = F.abs("log_ret")
    return trades.groupBy("symbol").agg(
        ratio(F.sum(x * F.col("price_diff")), F.sum(F.when(F.col("price_diff").isNotNull(), x * x))).alias("kyle"),
        ratio(F.sum(dv * r), F.sum(F.when(r.isNotNull(), dv * dv))).alias("amihud"),
        ratio(F.sum(h * r), F.sum(F.when(r.isNotNull(), h * h))).alias("hasbrouck"),
        ratio(F.sum(dv), F.sum("volume")).alias("vwap"),
        F.avg("volume").alias("average_tick_size"),
    )


def hhi(df: DataFrame, key: str, window: int, name: str = "hhi") -> DataFrame:
    """Herfindahl index of `key` over the last `window` rows: the sum over rows of their key's count is the sum of
    squared counts."""
    keys = F.collect_list(key).over(frame(window))
    counts = F.aggregate(
        "_k", F.lit(0).cast("long"), lambda s, k: s + F.size(F.filter("_k", lambda o: o == k)).cast("long")
    )
    held = df.select("*", keys.alias("_k"))
    return held.withColumn(name, F.when(F.size("_k") == window, counts / float(window * window))).drop("_k")
