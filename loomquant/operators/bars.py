"""Bars: time, tick, volume, dollar, run and imbalance bars over ticks (symbol, ts, ord, price, volume)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ohlcv import clean_ohlcv, interval_seconds
from .ordered import scan

ORDER = ["ts", "ord"]


def _positive(value: float, name: str) -> None:
    if not value > 0 or value != value or value == float("inf"):
        raise ValueError(f"{name} must be finite and positive")


class SumBars:
    """Bars of rows whose sum reaches the threshold: the row that reaches it closes the bar, and the next starts at 0."""

    def __init__(self, threshold: float):
        self.threshold, self.bar, self.carried = threshold, 0, 0.0

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bar of each row, and whether the row closes it."""
        n = len(values)
        bars, closes = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
        total = np.concatenate([[0.0], np.cumsum(values)])
        at = 0
        while at < n:
            end = int(np.searchsorted(total[at + 1 :], total[at] + self.threshold - self.carried, "left")) + at
            bars[at : end + 1] = self.bar
            if end >= n:
                self.carried += float(total[n] - total[at])
                break
            closes[end] = True
            at, self.bar, self.carried = end + 1, self.bar + 1, 0.0
        return bars, closes


class TimeBars:
    """A bar starts with its first trade; the trade at or after the interval closes it and belongs to it."""

    def __init__(self, interval_us: int):
        self.interval, self.bar, self.began = interval_us, 0, None

    def __call__(self, stamps_us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, at = len(stamps_us), 0
        bars = np.empty(n, dtype=np.int64)
        while at < n:
            after = at
            if self.began is None:
                self.began, after = int(stamps_us[at]), at + 1
            end = after + int(np.searchsorted(stamps_us[after:], self.began + self.interval, "left"))
            bars[at : end + 1] = self.bar
            if end >= n:
                break
            at, self.bar, self.began = end + 1, self.bar + 1, None
        return bars, np.ones(n, dtype=bool)  # the last bar stays as it is


class SignedBars:
    """Bars that follow the direction of prices; a zero tick keeps the direction, each bar starts anew with a trade that
    counts nothing. `length` closes after so many ticks in a row in one direction, `threshold` when signed weights reach it."""

    def __init__(self, *, length: int | None = None, threshold: float = 0.0):
        self.length, self.threshold = length, threshold
        self.bar, self.before, self.fresh = 0, None, True
        self.sign = self.total = 0.0
        self.run = 0

    def __call__(self, prices: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        n = len(prices)
        bars, closes = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
        step = np.sign(np.diff(prices, prepend=prices[0] if self.before is None else self.before))
        self.before = prices[-1]
        for i in range(n):
            bars[i] = self.bar
            if not self.fresh:
                direction = step[i] or self.sign
                if direction:
                    self.run = self.run + 1 if direction == self.sign else 1
                    self.sign = direction
                if weights is not None:
                    self.total += direction * weights[i]
            self.fresh = False
            if self.run >= self.length if self.length is not None else abs(self.total) >= self.threshold:
                closes[i] = True
                self.bar, self.fresh = self.bar + 1, True
                self.sign = self.total = 0.0
                self.run = 0
        return bars, closes


def _with_ids(ticks: DataFrame, start, values) -> DataFrame:
    """Ticks with the bar they are in and whether they close it. `values` picks what the kernel sees."""
    narrow = ticks.select("symbol", "ts", "ord", "price", "volume")

    def kernel():
        state = start()

        def step(c):
            bars, closes = state(*values(c))
            return {"bar_id": bars, "closes": closes}

        return step

    return scan(narrow, kernel, {"bar_id": T.LongType(), "closes": T.BooleanType()}, by=["symbol"], order=ORDER)


def build_closed_bars(marked: DataFrame) -> DataFrame:
    """Bars of ticks with bar_id and closes; a bar that no tick closes is left out."""
    closed = build_bars(marked, F.max("closes").alias("_closed"))
    return closed.where("_closed").drop("_closed")


def build_bars(marked: DataFrame, *more) -> DataFrame:
    """Canonical bars of ticks with a bar_id, with `more` aggregates."""
    at = F.struct("ts", "ord")
    bars = marked.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("ts"),
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.min("ts").alias("start_ts"),
        F.count("*").alias("n_obs"),
        F.sum(F.col("price") * F.col("volume")).alias("dollar_value"),
        *more,
    )
    return bars.withColumn("adj_close", F.col("close"))


def tick_bars(ticks: DataFrame, n: int) -> DataFrame:
    """Every n ticks of a symbol; the trailing partial bar is dropped."""
    _positive(n, "ticks per bar")
    w = Window.partitionBy("symbol").orderBy(*ORDER)
    rows = F.count("*").over(Window.partitionBy("symbol"))
    marked = ticks.select("*", F.floor((F.row_number().over(w) - 1) / n).alias("bar_id"), F.floor(rows / n).alias("_full"))
    return build_bars(marked.where(F.col("bar_id") < F.col("_full")))


def volume_bars(ticks: DataFrame, volume: float) -> DataFrame:
    _positive(volume, "volume per bar")
    return build_closed_bars(_with_ids(ticks, lambda: SumBars(volume), lambda c: (c["volume"],)))


def dollar_bars(ticks: DataFrame, value: float) -> DataFrame:
    _positive(value, "dollar value per bar")
    return build_closed_bars(_with_ids(ticks, lambda: SumBars(value), lambda c: (c["price"] * c["volume"],)))


def time_bars(ticks: DataFrame, interval: str = "1d") -> DataFrame:
    micros = interval_seconds(interval) * 1_000_000
    return build_closed_bars(_with_ids(ticks, lambda: TimeBars(micros), lambda c: (c["ts"].astype("datetime64[us]").astype(np.int64),)))


def run_bars(ticks: DataFrame, length: int) -> DataFrame:
    _positive(length, "run length")
    return build_closed_bars(_with_ids(ticks, lambda: SignedBars(length=length), lambda c: (c["price"],)))


def imbalance_bars(ticks: DataFrame, threshold: float, kind: str = "tick") -> DataFrame:
    _positive(threshold, "threshold")
    weights = {
        "tick": lambda c: np.ones(len(c["price"])),
        "volume": lambda c: c["volume"],
        "dollar": lambda c: c["price"] * c["volume"],
    }
    if kind not in weights:
        raise ValueError(f"unknown imbalance {kind!r}")
    return build_closed_bars(_with_ids(ticks, lambda: SignedBars(threshold=threshold), lambda c: (c["price"], weights[kind](c))))


def _as_ticks(ohlcv: DataFrame, ordinal: str | None) -> DataFrame:
    bars = clean_ohlcv(ohlcv, ordinal=ordinal)
    return bars.select("symbol", "ts", F.lit(0).cast("long").alias("ord"), F.col("close").alias("price"), "volume")


def build_time_bars(ohlcv: DataFrame, *, interval: str = "1d", ordinal: str | None = None) -> DataFrame:
    """Time bars of cleaned OHLCV rows, the close as the price; the other `build_` functions alike."""
    return time_bars(_as_ticks(ohlcv, ordinal), interval)


def build_tick_bars(ohlcv: DataFrame, *, ticks_per_bar: int = 50, ordinal: str | None = None) -> DataFrame:
    return tick_bars(_as_ticks(ohlcv, ordinal), ticks_per_bar)


def build_volume_bars(ohlcv: DataFrame, *, volume_per_bar: float = 100_000.0, ordinal: str | None = None) -> DataFrame:
    return volume_bars(_as_ticks(ohlcv, ordinal), volume_per_bar)


def build_dollar_bars(ohlcv: DataFrame, *, dollar_value_per_bar: float = 5_000_000.0, ordinal: str | None = None) -> DataFrame:
    return dollar_bars(_as_ticks(ohlcv, ordinal), dollar_value_per_bar)


def build_run_bars(ohlcv: DataFrame, *, length: int, ordinal: str | None = None) -> DataFrame:
    return run_bars(_as_ticks(ohlcv, ordinal), length)


def build_imbalance_bars(ohlcv: DataFrame, *, threshold: float, kind: str = "tick", ordinal: str | None = None) -> DataFrame:
    return imbalance_bars(_as_ticks(ohlcv, ordinal), threshold, kind)


def trade_sign(ticks: DataFrame, *, name: str = "sign") -> DataFrame:
    """Tick rule: the sign of the last price change that is not zero; null before any."""
    w = Window.partitionBy("symbol").orderBy(*ORDER)
    change = F.signum(F.col("price") - F.lag("price").over(w))
    return ticks.withColumn("_s", F.when(change != 0, change)).withColumn(name, F.last("_s", True).over(w)).drop("_s")


def bar_diagnostics(ohlcv: DataFrame, *, ordinal: str | None = None) -> DataFrame:
    """One row: bars, lag-1 autocorrelation of the returns and their squares, and their standard deviation. Lags go on
    across symbols, in order of symbol; only each symbol's last return crosses over, so no global sort is needed."""
    clean = clean_ohlcv(ohlcv, ordinal=ordinal)
    w = Window.partitionBy("symbol").orderBy("ts")
    last = F.lag("close").over(w)
    returns = clean.select("symbol", "ts", F.try_divide(F.col("close") - last, last).alias("ret")).where(F.col("ret").isNotNull())
    ends = returns.groupBy("symbol").agg(F.max_by("ret", "ts").alias("end"))  # a row for each symbol
    carried = ends.select("symbol", F.lag("end").over(Window.orderBy("symbol")).alias("before"))
    inner = returns.select("symbol", "ts", "ret", F.lag("ret").over(w).alias("prev"))
    pairs = inner.join(carried, "symbol").select(
        "ret", F.coalesce("prev", "before").alias("prev")
    )
    sums = pairs.agg(
        F.count("*").alias("n"),
        F.stddev_samp("ret").alias("std"),
        F.corr("ret", "prev").alias("ac"),
        F.corr(F.when(F.col("prev").isNotNull(), F.col("ret") * F.col("ret")), F.col("prev") * F.col("prev")).alias("ac2"),
    )
    enough = F.col("n") >= 3

    def known(c: str):
        return F.when(enough, F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias

    return sums.crossJoin(clean.agg(F.count("*").cast("double").alias("n_bars"))).select(
        "n_bars", known("ac")("lag1_return_autocorr"), known("ac2")("lag1_sq_return_autocorr"), known("std")("return_std")
    )
