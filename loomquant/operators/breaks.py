"""Structural breaks: Chow-type Dickey-Fuller, Chu-Stinchcombe-White and SADF statistics over log prices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def chow_type_stat(prices: DataFrame, min_length: int, *, value: str = "log_price") -> DataFrame:
    """(symbol, break, stat): t statistic of the lagged level from the break on, in closed form from suffix sums."""
    after = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("symbol")
    lagged = prices.select("symbol", "ts", (F.row_number().over(by_time()) - 1).alias("i"), F.lag(value).over(by_time()).alias("x"), (F.col(value) - F.lag(value).over(by_time())).alias("d"))
    # row i holds the pair (y[i-1], y[i] - y[i-1]); a break at b keeps the pairs from i = b + 1 on
    rows = lagged.where(F.col("i") > 0)
    sums = rows.select(
        "symbol",
        (F.col("i") - 1).alias("break"),
        F.sum(F.col("x") * F.col("d")).over(after).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).over(after).alias("sxx"),
        F.sum(F.col("d") * F.col("d")).over(every).alias("syy"),
        F.count("*").over(every).alias("n"),
    )
    beta = F.try_divide(F.col("sxy"), F.col("sxx"))
    rss = F.col("syy") - beta * F.col("sxy")
    variance = F.try_divide(rss / (F.col("n") - 1), F.col("sxx"))
    inside = (F.col("break") >= min_length) & (F.col("break") < F.col("n") + 1 - min_length)
    return sums.where(inside).select("symbol", "break", F.try_divide(beta, F.sqrt(variance)).alias("stat"))


def csw_values(y: np.ndarray, two_sided: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each end, the largest departure from an earlier level and the critical value of its distance."""
    n = len(y)
    variance = np.concatenate([[np.nan], np.cumsum(np.diff(y) ** 2)])
    stat, critical = np.full(n, np.nan), np.full(n, np.nan)
    for t in range(2, n):
        gap = y[t] - y[:t]
        distance = np.arange(t, 0, -1)
        s = (np.abs(gap) if two_sided else gap) / (variance[t] / (t - 1) * np.sqrt(distance))
        best = int(np.argmax(s))
        stat[t], critical[t] = s[best], np.sqrt(4.6 + np.log(distance[best]))
    return stat, critical


def _per_symbol(prices: DataFrame, value: str, schema: str, kernel) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending")])
        return kernel(table["symbol"][0].as_py(), table[value].to_numpy().astype(float))

    return prices.select("symbol", "ts", value).groupBy("symbol").applyInArrow(run, schema)


def chu_stinchcombe_white(prices: DataFrame, test: str = "one_sided", *, value: str = "log_price") -> DataFrame:
    """(symbol, i, stat, critical_value) from the third row on."""
    if test not in ("one_sided", "two_sided"):
        raise ValueError(f"unknown test {test!r}")

    def kernel(symbol: str, y: np.ndarray) -> pa.Table:
        stat, critical = csw_values(y, test == "two_sided")
        n = max(len(y) - 2, 0)
        return pa.table({"symbol": pa.array([symbol] * n, pa.string()), "i": pa.array(range(2, 2 + n), pa.int64()), "stat": stat[2:], "critical_value": critical[2:]})

    return _per_symbol(prices, value, "symbol string, i long, stat double, critical_value double", kernel)


MODELS = ("linear", "quadratic", "sm_poly_1", "sm_poly_2", "sm_exp", "sm_power")


def sadf_design(y: np.ndarray, model: str, lags: int | list[int], const: bool) -> tuple[np.ndarray, np.ndarray]:
    """Regressors and target of one series; the first regressor is the one that is tested."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    wanted = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    d = np.diff(y)
    rows = np.arange(max(wanted, default=0), len(d))  # of the differences; row r is the step from y[r] to y[r + 1]
    trend = np.arange(len(rows), dtype=float)
    one = np.ones(len(rows))
    if model in ("linear", "quadratic"):
        columns = [y[rows], *(d[rows - k] for k in wanted)]
        columns += [one] if const else []
        return np.column_stack([*columns, trend if model == "linear" else trend**2]), d[rows]
    level = y[rows + 1]
    target = level if model == "sm_poly_1" else np.log(level)
    if model in ("sm_poly_1", "sm_poly_2"):
        return np.column_stack([trend**2, one, trend]), target
    with np.errstate(divide="ignore"):
        return np.column_stack([trend if model == "sm_exp" else np.log(trend), one]), target


def sadf_values(x: np.ndarray, y: np.ndarray, min_length: int) -> np.ndarray:
    """For each end, the largest t statistic of the first regressor over all starts. The starts of one end share sums from
    the end backwards and are eliminated together; with a constant, regressors and target are measured from their values at
    the end, which leaves the statistic as it is and late windows of a long series as well conditioned as early ones."""
    n, k = x.shape
    first = int(np.flatnonzero(~np.isfinite(x).all(axis=1)).max(initial=-1)) + 1  # no start before an infinite regressor
    constant = np.flatnonzero((x[first:] == 1).all(axis=0))[:1]
    others = [c for c in range(1, k) if c not in constant]
    moving = np.column_stack([x[:, [*others, 0]], y]) if len(constant) else np.column_stack([x[:, [*range(1, k), 0]], y])
    out = np.full(n, -np.inf)
    for end in range(max(min_length, first), n):
        z = moving[first : end + 1][::-1].T
        if len(constant):
            z = np.vstack([np.ones(end + 1 - first), z - moving[end][:, None]])
        sums = np.cumsum(z[:, None, :] * z[None, :, :], axis=2)
        rows = np.arange(1, end + 2 - first)
        fits = (rows >= min_length) & (rows > k)
        sums, rows = sums[:, :, fits], rows[fits]
        if not len(rows):
            continue
        own = sums[range(k), range(k)]
        usable = np.ones(len(rows), dtype=bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(k - 1):  # the tested regressor and the target stay last
                usable &= sums[c, c] > 1e-13 * own[c]
                sums[c + 1 :, c + 1 :] -= sums[c + 1 :, None, c] * (sums[None, c, c + 1 :] / sums[c, c])
            usable &= sums[k - 1, k - 1] > 1e-13 * own[k - 1]
            beta = sums[k - 1, k] / sums[k - 1, k - 1]
            rss = sums[k, k] - beta * sums[k - 1, k]
            t = beta / np.sqrt(np.maximum(rss, 0) / (rows - k) / sums[k - 1, k - 1])
        t = t[usable & np.isfinite(t)]
        if len(t):
            out[end] = t.max()
    return out[min_length:]


def sadf(prices: DataFrame, model: str = "linear", *, lags: int | list[int] = 1, const: bool = True, min_length: int = 20, value: str = "log_price") -> DataFrame:
    """(symbol, i, sadf)."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")

    def kernel(symbol: str, series: np.ndarray) -> pa.Table:
        x, y = sadf_design(series, model, lags, const)
        values = sadf_values(x, y, min_length) if len(y) > min_length else np.empty(0)
        n = len(values)
        return pa.table({"symbol": pa.array([symbol] * n, pa.string()), "i": pa.array(range(min_length, min_length + n), pa.int64()), "sadf": values})

    return _per_symbol(prices, value, "symbol string, i long, sadf double", kernel)
