"""Portfolio construction: moments are Spark aggregates over long prices (ts, asset, price); weights are solved on the
driver on matrices whose size is the number of assets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = {None: 1, "D": 1, "day": 1, "W": 5, "week": 5, "weekly": 5, "M": 21, "month": 21, "monthly": 21}
RETURN_METHODS = ("mean", "mean_historical", "exponential", "exponential_historical")
MAX_ASSETS = 5_000


def step_of(resample_by: str | None) -> int:
    """Rows to a period; unknown names are days."""
    return STEPS.get(resample_by, 1)


def resample(prices: DataFrame, step: int) -> DataFrame:
    """Every step-th row of each asset."""
    n = F.row_number().over(Window.partitionBy("asset").orderBy("ts"))
    return prices if step == 1 else prices.withColumn("_n", n).where(F.col("_n") % step == 0).drop("_n")


def log_returns(prices: DataFrame) -> DataFrame:
    """(ts, asset, ret) from an asset's second row on."""
    before = F.lag("price").over(Window.partitionBy("asset").orderBy("ts"))
    return prices.select("ts", "asset", F.ln(F.try_divide(F.col("price"), before)).alias("ret")).where(F.col("ret").isNotNull())


def simple_returns(prices: DataFrame) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("asset").orderBy("ts"))
    return prices.select("ts", "asset", (F.try_divide(F.col("price"), before) - 1).alias("ret")).where(F.col("ret").isNotNull())


def covariance(returns: DataFrame, *, half: bool = False) -> DataFrame:
    """(a, b, cov): sample covariance over the times that both assets have; pairs are formed once, with a <= b, and come
    out both ways unless only `half` of the matrix is wanted."""
    left = returns.select("ts", F.col("asset").alias("a"), F.col("ret").alias("ra"))
    right = returns.select("ts", F.col("asset").alias("b"), F.col("ret").alias("rb"))
    once = left.join(right, "ts").where(F.col("a") <= F.col("b")).groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))
    if half:
        return once
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select(F.explode(ways).alias("w"), "cov").select("w.a", "w.b", "cov")


def expected_returns(returns: DataFrame, method: str = "mean", *, step: int = 1, span: int = 500) -> DataFrame:
    """(asset, mu), annualised; the exponential methods weigh recent rows more."""
    if method not in RETURN_METHODS:
        raise ValueError(f"unknown returns method {method!r}")
    scale = 252 / step
    if method.startswith("mean"):
        return returns.groupBy("asset").agg((F.avg("ret") * scale).alias("mu"))
    age = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts"))) - 1
    weight = F.pow(F.lit(1 - 2 / (span + 1)), F.col("_age"))
    aged = returns.withColumn("_age", age)
    return aged.groupBy("asset").agg((F.sum(F.col("ret") * weight) / F.sum(weight) * scale).alias("mu"))


@dataclass
class Inputs:
    assets: list[str]
    mu: np.ndarray
    cov: np.ndarray


def collect_inputs(prices: DataFrame, *, method: str = "mean", resample_by: str | None = None, simple: bool = False) -> Inputs:
    """Moments on the driver: a vector and a matrix over at most MAX_ASSETS assets."""
    step = step_of(resample_by)
    sampled = resample(prices, step)
    returns = (simple_returns if simple else log_returns)(sampled)
    mu = {r["asset"]: r["mu"] for r in expected_returns(returns, method, step=step).limit(MAX_ASSETS + 1).collect()}
    if len(mu) > MAX_ASSETS:
        raise ValueError(f"more than {MAX_ASSETS} assets")
    assets = sorted(mu)
    table = pa.array(assets)
    half = covariance(returns, half=True).toArrow()  # columnar: a matrix of MAX_ASSETS has 12.5 million cells
    i, j = (pc.index_in(half[c].combine_chunks(), table).to_numpy() for c in ("a", "b"))
    cov = np.zeros((len(assets), len(assets)))
    cov[i, j] = cov[j, i] = half["cov"].to_numpy()
    return Inputs(assets, np.array([mu[a] for a in assets]), cov)


Bounds = tuple[float, float] | dict[str, tuple[float, float]] | None


def bounds_of(assets: list[str], bounds: Bounds) -> np.ndarray:
    if isinstance(bounds, dict):
        out = np.array([bounds.get(a, (0.0, 1.0)) for a in assets])
    else:
        out = np.tile(bounds or (-np.inf, np.inf), (len(assets), 1))
    if out[:, 0].clip(-1e9).sum() > 1 + 1e-12 or np.minimum(out[:, 1], 1).sum() < 1 - 1e-12 and bounds is not None:
        raise ValueError("the bounds leave no weights that sum to 1")
    return out


def project(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cuts at the bounds and spreads what is over or missing in proportion to the room that is left."""
    w = np.clip(weights, bounds[:, 0], bounds[:, 1])
    gap = 1 - w.sum()
    if abs(gap) > 1e-15 and np.isfinite(bounds).all():
        room = bounds[:, 1] - w if gap > 0 else w - bounds[:, 0]
        if room.sum() <= 0:
            raise ValueError("the bounds leave no room")
        w = w + gap * room / room.sum()
    return w


def inverse_variance_weights(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def min_vol_weights(cov: np.ndarray) -> np.ndarray:
    w = np.linalg.solve(cov, np.ones(len(cov)))
    return w / w.sum()


def max_sharpe_weights(cov: np.ndarray, mu: np.ndarray, risk_free: float) -> np.ndarray:
    w = np.linalg.solve(cov, mu - risk_free)
    if abs(w.sum()) < 1e-15:
        raise ValueError("the tangency portfolio is not defined")
    return w / w.sum()


def efficient_risk_weights(cov: np.ndarray, mu: np.ndarray, target: float) -> np.ndarray:
    """Least variance at the target return."""
    one = np.ones(len(mu))
    si, sm = np.linalg.solve(cov, one), np.linalg.solve(cov, mu)
    a, b, c = one @ si, one @ sm, mu @ sm
    delta = a * c - b * b
    if abs(delta) < 1e-18:
        raise ValueError("the frontier is not defined")
    return ((c - b * target) * si + (a * target - b) * sm) / delta


@dataclass
class Allocation:
    assets: list[str]
    weights: np.ndarray
    risk: float
    expected: float
    sharpe: float
    extra: dict = field(default_factory=dict)

    def frame(self, spark) -> DataFrame:
        rows = [(a, float(w)) for a, w in zip(self.assets, self.weights, strict=True)]
        return spark.createDataFrame(rows, "asset string, weight double")


SOLUTIONS = ("inverse_variance", "min_volatility", "max_sharpe", "efficient_risk")


def allocate_from_inputs(inputs: Inputs, solution: str, *, risk_free: float = 0.0, target_return: float = 0.0, bounds: Bounds = None) -> Allocation:
    cov, mu = inputs.cov, inputs.mu
    if solution == "inverse_variance":
        w = inverse_variance_weights(cov)
    elif solution == "min_volatility":
        w = min_vol_weights(cov)
    elif solution == "max_sharpe":
        w = max_sharpe_weights(cov, mu, risk_free)
    elif solution == "efficient_risk":
        w = efficient_risk_weights(cov, mu, target_return)
    else:
        raise ValueError(f"unknown solution {solution!r}")
    w = project(w, bounds_of(inputs.assets, bounds)) if bounds is not None else w
    risk = float(np.sqrt(max(w @ cov @ w, 0.0)))
    expected = float(w @ mu)
    return Allocation(inputs.assets, w, risk, expected, (expected - risk_free) / risk if risk > 0 else float("nan"))


def allocate(prices: DataFrame, solution: str = "inverse_variance", *, method: str = "mean", resample_by: str | None = None, **options) -> Allocation:
    return allocate_from_inputs(collect_inputs(prices, method=method, resample_by=resample_by), solution, **options)


def inverse_variance(prices: DataFrame) -> DataFrame:
    """(asset, weight) without the driver: for any number of assets."""
    inverse = log_returns(prices).groupBy("asset").agg((1 / F.var_samp("ret")).alias("iv"))
    return inverse.crossJoin(inverse.agg(F.sum("iv").alias("t"))).select("asset", (F.col("iv") / F.col("t")).alias("weight"))


def efficient_frontier(inputs: Inputs, points: int = 100, *, bounds: Bounds = None) -> list[Allocation]:
    """Frontier portfolios for targets from the least-variance return to the largest mean."""
    low = float(min_vol_weights(inputs.cov) @ inputs.mu)
    targets = np.linspace(low, float(inputs.mu.max()), points)
    return [allocate_from_inputs(inputs, "efficient_risk", target_return=float(t), bounds=bounds) for t in targets]


def cla_allocate(prices: DataFrame, solution: str = "cla_turning_points", *, bounds: Bounds = (0.0, 1.0), method: str = "mean", resample_by: str | None = None, risk_free: float = 0.0):
    """Least-variance point (also for the turning points), maximum Sharpe ratio, or the frontier. Unlike implementations
    that repeat one point, the frontier is swept over target returns."""
    inputs = collect_inputs(prices, method=method, resample_by=resample_by, simple=True)
    if solution in ("cla_turning_points", "min_volatility"):
        return allocate_from_inputs(inputs, "min_volatility", bounds=bounds)
    if solution == "max_sharpe":
        return allocate_from_inputs(inputs, "max_sharpe", risk_free=risk_free, bounds=bounds)
    if solution == "efficient_frontier":
        return efficient_frontier(inputs, bounds=bounds)
    raise ValueError(f"unknown solution {solution!r}")


@dataclass
class TurningPoint:
    """Weights at a value of lambda (risk tolerance) where an asset enters or leaves a bound."""

    weights: np.ndarray
    tolerance: float
    free: list[int] = field(default_factory=list)


def critical_line(mu: np.ndarray, cov: np.ndarray, bounds: np.ndarray, tol: float = 1e-10) -> list[TurningPoint]:
    """All turning points of the bounded frontier, from the largest mean down to the least variance. On a segment the
    weights of the free assets are affine in lambda, so the next event is the largest lambda below at which a free asset
    meets a bound or a bound asset wants to leave it. Points that a rounding error has put off the budget or the bounds are
    left out."""
    lower, upper = bounds[:, 0], bounds[:, 1]
    if not np.isfinite(bounds).all() or (lower > upper).any() or lower.sum() > 1 or upper.sum() < 1:
        raise ValueError("the bounds leave no weights that sum to 1")
    n = len(mu)
    w = lower.astype(float).copy()
    free: list[int] = []
    for i in np.argsort(-mu, kind="stable").tolist():  # the largest mean that the bounds allow
        room = 1 - w.sum()
        if room <= tol:
            break
        w[i] += min(room, upper[i] - lower[i])
        free = [i]
    points = [TurningPoint(w.copy(), np.inf, list(free))]

    def line(held: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Free weights as base + lambda * slope."""
        inverse = np.linalg.inv(cov[np.ix_(held, held)])
        rest = [i for i in range(n) if i not in held]
        one = np.ones(len(held))
        fixed = inverse @ cov[np.ix_(held, rest)] @ w[rest] if rest else np.zeros(len(held))
        total = one @ inverse @ one
        base = -fixed + inverse @ one * (1 - w[rest].sum() + fixed.sum()) / total
        slope = inverse @ mu[held] - inverse @ one * (one @ inverse @ mu[held]) / total
        return base, slope

    now = np.inf
    for _ in range(20 * n + 20):
        best: tuple[float, int, float | None] = (0.0, -1, None)
        base, slope = line(free)
        if len(free) > 1:
            for k, i in enumerate(free):
                if abs(slope[k]) > tol:
                    bound = lower[i] if slope[k] > 0 else upper[i]
                    at = (bound - base[k]) / slope[k]
                    if tol < at < now - tol and at > best[0]:
                        best = (at, i, float(bound))
        for i in (i for i in range(n) if i not in free and upper[i] - lower[i] > tol):
            b, s = line([*free, i])
            if abs(s[-1]) > tol:
                at = (w[i] - b[-1]) / s[-1]
                if tol < at < now - tol and at > best[0]:
                    best = (at, i, None)
        at, i, bound = best
        w[free] = base + at * slope
        if i < 0:  # least variance
            points.append(TurningPoint(w.copy(), 0.0, list(free)))
            break
        now = at
        if bound is None:
            free = [*free, i]
        else:
            w[i] = bound
            free = [f for f in free if f != i]
        points.append(TurningPoint(w.copy(), at, list(free)))
    kept = [p for p in points if abs(p.weights.sum() - 1) < 1e-6 and (p.weights >= lower - 1e-6).all() and (p.weights <= upper + 1e-6).all()]
    return [p for k, p in enumerate(kept) if k == 0 or p.weights @ mu <= kept[k - 1].weights @ mu + 1e-12]


def min_variance_bounded(cov: np.ndarray, bounds: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    """The bounded weights of least variance: the last turning point."""
    means = np.arange(len(cov), 0, -1.0) * 1e-3 if mu is None else mu
    return critical_line(means, cov, bounds)[-1].weights


# Hierarchies


def cov_to_corr(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    if not (sd > 0).all():
        raise ValueError("variances must be positive")
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def shrink(cov: np.ndarray, alpha: float) -> np.ndarray:
    out = cov * (1 - alpha)
    np.fill_diagonal(out, np.diag(cov))
    return out


def single_linkage(distance: np.ndarray) -> list[tuple[int, int]]:
    """Merges of clusters by id; new clusters count on from the number of leaves, ties go to smaller ids."""
    n = len(distance)
    between = {(i, j): distance[i, j] for i in range(n) for j in range(i + 1, n)}
    alive, merges = list(range(n)), []
    for new in range(n, 2 * n - 1):
        a, b = min(between, key=lambda p: (between[p], p))
        merges.append((a, b))
        alive = [c for c in alive if c not in (a, b)]
        for c in alive:
            d = min(between.pop((min(a, c), max(a, c))), between.pop((min(b, c), max(b, c))))
            between[c, new] = d
        between.pop((a, b))
        alive.append(new)
    return merges


def leaf_order(n: int, merges: list[tuple[int, int]]) -> list[int]:
    """Leaves from left to right, without recursion."""
    out, stack = [], [2 * n - 2] if n > 1 else [0]
    while stack:
        c = stack.pop()
        if c < n:
            out.append(c)
        else:
            a, b = merges[c - n]
            stack += [b, a]
    return out


def cluster_variance(cov: np.ndarray, items: list[int]) -> float:
    part = cov[np.ix_(items, items)]
    w = inverse_variance_weights(part)
    return float(w @ part @ w)


def bisect(order: list[int], share) -> np.ndarray:
    """Splits the ordered leaves in halves; `share(left, right)` is the part of the weight that goes left."""
    w = np.ones(len(order))
    stack = [order]
    while stack:
        items = stack.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        alpha = min(max(share(left, right), 0.0), 1.0)
        w[left] *= alpha
        w[right] *= 1 - alpha
        stack += [left, right]
    return w


def hrp_weights(cov: np.ndarray, *, shrinkage: bool = False) -> tuple[np.ndarray, list[int]]:
    cov = shrink(cov, 0.1) if shrinkage else cov
    merges = single_linkage(np.sqrt((1 - cov_to_corr(cov)) / 2))
    order = leaf_order(len(cov), merges)

    def share(left: list[int], right: list[int]) -> float:
        a, b = cluster_variance(cov, left), cluster_variance(cov, right)
        return 1 - a / (a + b)

    return bisect(order, share), order


def allocate_hrp(prices: DataFrame, *, shrinkage: bool = False, resample_by: str | None = None) -> Allocation:
    """Hierarchical risk parity."""
    inputs = collect_inputs(prices, resample_by=resample_by, simple=True)
    w, order = hrp_weights(inputs.cov, shrinkage=shrinkage)
    risk = float(np.sqrt(w @ inputs.cov @ w))
    return Allocation(inputs.assets, w, risk, float(w @ inputs.mu), float("nan"), {"order": [inputs.assets[i] for i in order]})


HCAA_METRICS = ("minimum_variance", "minimum_standard_deviation", "sharpe_ratio", "equal_weighting", "expected_shortfall", "conditional_drawdown_risk")


def cluster_tail(returns: np.ndarray, confidence: float, drawdown: bool) -> float:
    """Expected shortfall, or mean of the worst drawdowns of the compounded value, of a return series."""
    if not drawdown:
        bound = np.sort(returns)[round(confidence * (len(returns) - 1))]
        return float(-returns[returns <= bound].mean())
    value = np.cumprod(1 + returns)
    down = 1 - value / np.maximum.accumulate(value)
    bound = np.sort(down)[round((1 - confidence) * (len(down) - 1))]
    return float(down[down >= bound].mean())


def hcaa_weights(cov: np.ndarray, mu: np.ndarray, returns: np.ndarray | None, metric: str, confidence: float = 0.05) -> np.ndarray:
    if metric not in HCAA_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    order = leaf_order(len(cov), single_linkage(np.sqrt(2 * (1 - cov_to_corr(cov)))))

    def score(items: list[int]) -> float:
        part = cov[np.ix_(items, items)]
        w = inverse_variance_weights(part)
        variance = float(w @ part @ w)
        if metric == "minimum_variance":
            return variance
        if metric == "minimum_standard_deviation":
            return variance**0.5
        if metric == "sharpe_ratio":
            return float(w @ mu[items]) / variance**0.5
        return cluster_tail(returns[:, items] @ w, confidence, metric == "conditional_drawdown_risk")

    def share(left: list[int], right: list[int]) -> float:
        if metric == "equal_weighting":
            return 0.5
        a, b = score(left), score(right)
        if a + b == 0:
            return 0.5
        if metric == "sharpe_ratio":
            alpha = a / (a + b)
            return alpha if 0 <= alpha <= 1 else 1 - cluster_variance(cov, left) / (cluster_variance(cov, left) + cluster_variance(cov, right))
        return 1 - a / (a + b)

    return bisect(order, share)


MAX_RETURN_CELLS = 50_000_000


def allocate_hcaa(prices: DataFrame, metric: str = "equal_weighting", *, confidence: float = 0.05, resample_by: str | None = None) -> Allocation:
    """Hierarchical clustering asset allocation. Tail metrics need the returns, at most MAX_RETURN_CELLS of them; a time
    without a price counts as a return of 0."""
    inputs = collect_inputs(prices, resample_by=resample_by, simple=True)
    matrix = None
    if metric in HCAA_METRICS[4:]:
        rets = simple_returns(resample(prices, step_of(resample_by)))
        if rets.count() > MAX_RETURN_CELLS:
            raise ValueError("too many returns for a tail metric")
        wide = rets.toPandas().pivot(index="ts", columns="asset", values="ret")[inputs.assets].fillna(0.0)
        matrix = wide.to_numpy()
    w = hcaa_weights(inputs.cov, inputs.mu, matrix, metric, confidence)
    return Allocation(inputs.assets, w, float(np.sqrt(w @ inputs.cov @ w)), float(w @ inputs.mu), float("nan"))


def dendrogram(assets: list[str], merges: list[tuple[int, int]]) -> dict:
    """Plot coordinates of the merge tree."""
    n = len(assets)
    order = leaf_order(n, merges)
    x, height = {leaf: 10.0 * k + 5 for k, leaf in enumerate(order)}, {i: 0.0 for i in range(n)}
    icoord, dcoord = [], []
    for k, (a, b) in enumerate(merges):
        top = max(height[a], height[b]) + 1
        icoord.append([x[a], x[a], x[b], x[b]])
        dcoord.append([height[a], top, top, height[b]])
        x[n + k], height[n + k] = (x[a] + x[b]) / 2, top
    return {"icoord": icoord, "dcoord": dcoord, "leaves": order, "ivl": [assets[i] for i in order]}


# Optimal number of clusters


def kmeans(data: np.ndarray, k: int, rng: np.random.Generator, iterations: int = 100) -> np.ndarray:
    centers = data[rng.permutation(len(data))[:k]]
    labels = np.full(len(data), -1)
    for _ in range(iterations):
        new = ((data[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        centers = np.array([data[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(k)])
    return labels


def silhouettes(data: np.ndarray, labels: np.ndarray) -> np.ndarray:
    distance = np.sqrt(((data[:, None] - data) ** 2).sum(axis=2))
    out = np.zeros(len(data))
    groups = {c: np.flatnonzero(labels == c) for c in np.unique(labels)}
    for i in range(len(data)):
        own = groups[labels[i]]
        if len(own) < 2 or len(groups) < 2:
            continue
        a = distance[i, own].sum() / (len(own) - 1)
        b = min(distance[i, g].mean() for c, g in groups.items() if c != labels[i])
        out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def _quality(s: np.ndarray) -> float:
    sd = s.std()
    return float(s.mean() / sd) if sd > 0 else 0.0


def _base_clusters(corr: np.ndarray, most: int, repeat: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.sqrt(np.maximum((1 - corr) / 2, 0))
    best = None
    for rep in range(repeat):
        for k in range(2, most + 1):
            labels = kmeans(data, k, np.random.default_rng([seed, rep, k]))
            s = silhouettes(data, labels)
            if best is None or _quality(s) > best[0]:
                best = (_quality(s), labels, s)
    return best[1], best[2]


def onc_clusters(corr: np.ndarray, repeat: int = 10, seed: int = 42) -> tuple[list[list[int]], np.ndarray]:
    """Clusters of a correlation matrix and the silhouette of each item; clusters of less than average quality are
    clustered again while that improves them."""
    n = len(corr)
    if n < 3:
        return [list(range(n))], np.zeros(n)
    labels, s = _base_clusters(corr, n - 1, repeat, seed)
    groups = [np.flatnonzero(labels == c).tolist() for c in np.unique(labels)]
    quality = [_quality(s[g]) for g in groups]
    mean = float(np.mean(quality))
    weak = [g for g, q in zip(groups, quality, strict=True) if q < mean]
    if len(weak) <= 2:
        return groups, s
    items = [i for g in weak for i in g]
    inner, _ = onc_clusters(corr[np.ix_(items, items)], repeat, seed + 1)
    redone = [g for g in groups if g not in weak] + [[items[i] for i in g] for g in inner]
    new_labels = np.empty(n, dtype=int)
    for c, g in enumerate(redone):
        new_labels[g] = c
    new_s = silhouettes(np.sqrt(np.maximum((1 - corr) / 2, 0)), new_labels)
    better = np.mean([_quality(new_s[g]) for g in redone]) > mean
    return (redone, new_s) if better else (groups, s)
