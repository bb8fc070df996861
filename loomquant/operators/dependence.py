"""Dependence measures between two columns x and y of a group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def angular_distances(df: DataFrame, x: str, y: str, *, by: str = "symbol") -> DataFrame:
    """(symbol, angular, absolute_angular, squared_angular) of the correlation; null without variance."""
    rho = df.groupBy(by).agg(F.nanvl(F.corr(x, y), F.lit(None)).alias("r"))
    one = [F.lit(0.5) * (1 - v) for v in (F.col("r"), F.abs("r"), F.col("r") * F.col("r"))]
    names = ("angular", "absolute_angular", "squared_angular")
    return rho.select(by, *[F.sqrt(F.greatest(v, F.lit(0.0))).alias(n) for v, n in zip(one, names, strict=True)])


def _distance_means(v: np.ndarray) -> np.ndarray:
    """Mean distance of each value to all values."""
    n = len(v)
    order = np.argsort(v, kind="stable")
    ranked = v[order]
    total = np.concatenate([[0.0], np.cumsum(ranked)])
    i = np.arange(n)
    sums = ranked * i - total[:-1] + (total[-1] - total[1:]) - ranked * (n - 1 - i)
    out = np.empty(n)
    out[order] = sums / n
    return out


def distance_correlation_values(x: np.ndarray, y: np.ndarray, block: int = 512) -> float:
    """Distance correlation with memory for `block` rows of the distance matrices at a time."""
    n = len(x)
    a_row, b_row = _distance_means(x), _distance_means(y)
    a_all, b_all = a_row.mean(), b_row.mean()
    sums = np.zeros(3)
    for s in range(0, n, block):
        a = np.abs(x[s : s + block, None] - x) - a_row[s : s + block, None] - a_row + a_all
        b = np.abs(y[s : s + block, None] - y) - b_row[s : s + block, None] - b_row + b_all
        sums += (a * b).sum(), (a * a).sum(), (b * b).sum()
    xy, xx, yy = sums / (n * n)
    return math.sqrt(max(xy, 0.0)) / math.sqrt(math.sqrt(xx * yy)) if xx > 0 and yy > 0 else float("nan")


def _distance_product(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |xi - xj| |yi - yj| over all pairs i, j, by merging halves in the order of x: an element of a right half
    meets those of the left half that are below it in y as running sums."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    at = np.arange(n)
    values = np.stack([np.ones(n), x, y, x * y])
    below = np.zeros((4, n))
    width = 1
    while width < n:
        group = at // (2 * width)
        by = np.argsort(group * n + rank)
        left = (by // width) % 2 == 0
        run = np.concatenate([np.zeros((4, 1)), np.cumsum(values[:, by] * left, axis=1)], axis=1)
        right = np.flatnonzero(~left)
        below[:, by[right]] += run[:, right] - run[:, group[by[right]] * (2 * width)]
        width *= 2
    earlier = np.cumsum(values, axis=1) - values

    def products(s: np.ndarray) -> float:
        return float((s[0] * x * y - x * s[2] - y * s[1] + s[3]).sum())

    return 2 * (2 * products(below) - products(earlier))


def fast_distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The same as distance_correlation_values in n log(n) squared steps and memory for the values only."""
    n = len(x)
    x, y = x - np.median(x), y - np.median(y)  # smaller sums; equal values give 0
    a_row, b_row = _distance_means(x), _distance_means(y)
    a_all, b_all = a_row.mean(), b_row.mean()
    xy = _distance_product(x, y) / (n * n) - 2 * (a_row * b_row).mean() + a_all * b_all
    xx = 2 * x.var() - 2 * (a_row * a_row).mean() + a_all * a_all
    yy = 2 * y.var() - 2 * (b_row * b_row).mean() + b_all * b_all
    return math.sqrt(max(xy, 0.0)) / math.sqrt(math.sqrt(xx * yy)) if xx > 0 and yy > 0 else float("nan")


def distance_correlation(df: DataFrame, x: str, y: str, *, by: str = "symbol") -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        value = fast_distance_correlation(table[x].to_numpy().astype(float), table[y].to_numpy().astype(float))
        return pa.table({by: table[by].slice(0, 1), "distance_correlation": pa.array([value], pa.float64(), from_pandas=True)})

    return df.select(by, x, y).groupBy(by).applyInArrow(run, f"{by} string, distance_correlation double")


def optimal_bins(n: int, correlation: float | None = None) -> int:
    """Number of histogram bins by Hacine-Gharbi; the bivariate formula needs a correlation below 1."""
    if n < 1:
        raise ValueError("no observations")
    if correlation is None or abs(abs(correlation) - 1) <= 1e-4:
        z = (8 + 324 * n + 12 * math.sqrt(36 * n + 729 * n * n)) ** (1 / 3)
        bins = round(z / 6 + 2 / (3 * z) + 1 / 3)
    else:
        bins = round(math.sqrt(0.5) * math.sqrt(1 + math.sqrt(1 + 24 * n / (1 - correlation**2))))
    return max(1, int(bins))


def _binned(df: DataFrame, x: str, y: str, n_bins: int, by: str) -> DataFrame:
    w = Window.partitionBy(by)

    def bin_of(c: str):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        at = F.floor(F.try_divide(F.col(c) - lo, (hi - lo) / n_bins))
        return F.least(F.coalesce(at, F.lit(n_bins - 1)), F.lit(n_bins - 1))

    return df.select(by, bin_of(x).alias("bx"), bin_of(y).alias("by_")).groupBy(by, "bx", "by_").agg(F.count("*").alias("c"))


def histogram(df: DataFrame, x: str, n_bins: int, *, by: str = "symbol") -> DataFrame:
    """(symbol, bin, count) of all bins of equal width from the least to the greatest value, which is in the last bin; a
    constant series is in the last bin."""
    cells = _binned(df, x, x, n_bins, by).select(by, F.col("bx").alias("bin"), F.col("c").alias("count"))
    grid = cells.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    return grid.join(cells.withColumn("bin", F.col("bin").cast("long")), [by, "bin"], "left").select(by, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def histogram2d(df: DataFrame, x: str, y: str, n_bins: int, *, by: str = "symbol") -> DataFrame:
    """(symbol, bin_x, bin_y, count) of the bins that are not empty."""
    return _binned(df, x, y, n_bins, by).select(by, F.col("bx").alias("bin_x"), F.col("by_").alias("bin_y"), F.col("c").alias("count"))


def information(df: DataFrame, x: str, y: str, n_bins: int, *, by: str = "symbol") -> DataFrame:
    """(symbol, mutual_info, normalized_mutual_info, variation, normalized_variation) in nats. After binning, at most
    n_bins squared rows of a group are left."""
    cells = _binned(df, x, y, n_bins, by)
    total = F.sum("c").over(Window.partitionBy(by))
    p = cells.select(by, "bx", "by_", (F.col("c") / total).alias("p"))
    px, py = (F.sum("p").over(Window.partitionBy(by, c)) for c in ("bx", "by_"))
    q = p.select(by, "bx", "by_", "p", px.alias("px"), py.alias("py"))
    joint = q.groupBy(by).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), (-F.sum(F.col("p") * F.ln("p"))).alias("hxy"))
    hx = p.groupBy(by, "bx").agg(F.sum("p").alias("p")).groupBy(by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("hx"))
    hy = p.groupBy(by, "by_").agg(F.sum("p").alias("p")).groupBy(by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("hy"))
    got = joint.join(hx, by).join(hy, by)
    vi = F.col("hx") + F.col("hy") - 2 * F.col("mi")
    return got.select(
        by,
        F.col("mi").alias("mutual_info"),
        F.coalesce(F.try_divide(F.col("mi"), F.least("hx", "hy")), F.lit(0.0)).alias("normalized_mutual_info"),
        vi.alias("variation"),
        F.coalesce(F.try_divide(vi, F.col("hxy")), F.lit(0.0)).alias("normalized_variation"),
    )
