"""Simulation and search: mean-reverting paths and optimal trading rules, mixture moments, integer decisions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ornstein-Uhlenbeck paths and trading rules


def calibrate_ou(prices: DataFrame, *, value: str = "price") -> DataFrame:
    """(symbol, phi, intercept, equilibrium, sigma, r_squared, stationary) of the first-order autoregression."""
    before = F.lag(value).over(Window.partitionBy("symbol").orderBy("ts"))
    pairs = prices.select("symbol", F.col(value).alias("y"), before.alias("x")).where(F.col("x").isNotNull())
    fit = pairs.groupBy("symbol").agg(
        F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"),
        F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"), F.count("*").alias("_n"),
    )
    rss = F.greatest(F.col("_syy") - F.col("phi") * F.col("_sxy"), F.lit(0.0))
    return fit.select(
        "symbol", "phi", "intercept", F.try_divide(F.col("intercept"), 1 - F.col("phi")).alias("equilibrium"),
        F.sqrt(F.try_divide(rss, F.col("_n") - 1)).alias("sigma"), "r_squared", ((F.col("phi") > 0) & (F.col("phi") < 1)).alias("stationary"),
    )


@dataclass(frozen=True)
class OuParams:
    phi: float
    equilibrium: float
    sigma: float


def ou_paths(spark: SparkSession, params: OuParams, start: float, n_paths: int, horizon: int, seed: int = 0) -> DataFrame:
    """(path, step, price) from step 0; a path's numbers depend on the seed and the path only."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                noise = np.random.default_rng([seed, path]).normal(0, params.sigma, horizon)
                price = np.empty(horizon + 1)
                price[0] = start
                for t in range(horizon):
                    price[t + 1] = params.equilibrium * (1 - params.phi) + params.phi * price[t] + noise[t]
                yield pa.RecordBatch.from_arrays([pa.array([path] * (horizon + 1), pa.int64()), pa.array(range(horizon + 1), pa.int32()), pa.array(price)], ["path", "step", "price"])

    return spark.range(n_paths).withColumnRenamed("id", "path").mapInArrow(run, "path long, step int, price double")


def rule_surface(paths: DataFrame, profit: list[float], stop: list[float], max_holding: int, annualization: float = 252.0) -> DataFrame:
    """(profit, stop, sharpe, mean, std, win_rate, holding) for a mesh of barriers: a position leaves at the first step
    with a gain of `profit` or more, a loss of `stop` or more, or at the holding limit. The mesh goes to each row as a
    bounded array; each path is reduced to one exit for each rule."""
    rules = F.array(*[F.struct(F.lit(float(p)).alias("profit"), F.lit(float(s)).alias("stop")) for p in profit for s in stop])
    first = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = paths.where(F.col("step") <= max_holding).select("path", "step", (F.col("price") - F.first("price").over(first)).alias("pnl"))
    each = moved.where("step > 0").select("path", "step", "pnl", F.explode(rules).alias("r")).select("path", "step", "pnl", "r.*")
    hit = (F.col("pnl") >= F.col("profit")) | (F.col("pnl") <= -F.col("stop"))
    last = F.struct("step", "pnl")
    exits = each.groupBy("profit", "stop", "path").agg(F.coalesce(F.min(F.when(hit, last)), F.max(last)).alias("x"))
    sums = exits.groupBy("profit", "stop").agg(
        F.avg("x.pnl").alias("mean"), F.coalesce(F.stddev_samp("x.pnl"), F.lit(0.0)).alias("std"),
        F.avg((F.col("x.pnl") > 0).cast("double")).alias("win_rate"), F.avg("x.step").alias("holding"),
    )
    ratio = F.coalesce(F.try_divide(F.col("mean"), F.col("std")), F.lit(0.0))
    return sums.withColumn("sharpe", ratio * F.sqrt(F.try_divide(F.lit(annualization), F.greatest("holding", F.lit(1.0)))))


def best_rule(surface: DataFrame) -> DataFrame:
    """The rule of the highest Sharpe ratio, then mean."""
    return surface.orderBy(F.desc("sharpe"), F.desc("mean"), "profit", "stop").limit(1)


def no_stable_optimum(surface: DataFrame, phi: float, *, min_gap: float = 0.1, min_std: float = 0.05, near_walk: float = 0.99) -> DataFrame:
    """One row: gap of the best to the median Sharpe ratio, deviation of the surface, and whether there is no rule worth
    choosing."""
    s = surface.agg(F.max("sharpe").alias("best"), F.percentile("sharpe", 0.5).alias("median"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std"))
    flat = (F.col("best") - F.col("median") < min_gap) | (F.col("std") < min_std)
    return s.select((F.col("best") - F.col("median")).alias("gap"), "std", (flat | F.lit(abs(phi) >= near_walk)).alias("no_stable_optimum"))


def otr_workflow(prices: DataFrame, *, n_paths: int, horizon: int, profit: list[float], stop: list[float], max_holding: int, seed: int = 0) -> tuple[OuParams, DataFrame, DataFrame, DataFrame]:
    """Calibrates one symbol's prices (symbol, ts, price), simulates paths from its equilibrium and searches the mesh of
    barriers. Returns the parameters, the surface, its best rule and whether there is a stable optimum."""
    fits = calibrate_ou(prices).limit(2).collect()
    if len(fits) != 1:
        raise ValueError("the workflow takes the prices of one symbol")
    fit = fits[0]
    if not fit["stationary"]:
        raise ValueError("the prices do not revert to a mean")
    params = OuParams(fit["phi"], fit["equilibrium"], fit["sigma"])
    surface = rule_surface(ou_paths(prices.sparkSession, params, params.equilibrium, n_paths, horizon, seed), profit, stop, max_holding)
    return params, surface, best_rule(surface), no_stable_optimum(surface, params.phi)


# Two-normal mixtures from moments


def raw_moments(mu1: float, mu2: float, s1: float, s2: float, p: float) -> list[float]:
    """First five raw moments of a mixture of two normals."""

    def one(m: float, s: float) -> list[float]:
        v = s * s
        return [m, m**2 + v, m**3 + 3 * m * v, m**4 + 6 * m * m * v + 3 * v * v, m**5 + 10 * m**3 * v + 15 * m * v * v]

    return [p * a + (1 - p) * b for a, b in zip(one(mu1, s1), one(mu2, s2), strict=True)]


def centered_moment(moments: list[float], order: int) -> float:
    """Central moment of an order from raw moments (the first one is the mean)."""
    full = [1.0, *moments]
    return sum((-1) ** (order - k) * math.comb(order, k) * full[k] * moments[0] ** (order - k) for k in range(order + 1))


def raw_from_central(central: list[float], mean: float) -> list[float]:
    """Raw moments from central ones (the first of them is 0 by definition) and the mean."""
    full = [1.0, *central]
    return [mean] + [sum(math.comb(n, k) * full[k] * mean ** (n - k) for k in range(n + 1)) for n in range(2, len(full))]


def _step(moments: list[float], mu2: float, p: float, five: bool) -> tuple[float, ...] | None:
    m1, m2, m3, m4, m5 = moments
    if not 0 < p < 1:
        return None
    mu1 = (m1 - (1 - p) * mu2) / p
    if abs(mu2 - mu1) < 1e-12:
        return None
    v2 = (m3 + 2 * p * mu1**3 + (p - 1) * mu2**3 - 3 * mu1 * (m2 + mu2**2 * (p - 1))) / (3 * (1 - p) * (mu2 - mu1))
    if v2 < 0:
        return None
    v1 = (m2 - v2 - mu2**2) / p + v2 + mu2**2 - mu1**2
    if v1 < 0:
        return None
    if five:
        inside = 9 * v2**2 + (m4 - p * (3 * v1**2 + 6 * v1 * mu1**2 + mu1**4)) / (1 - p) - 3 * v2**2
        if inside < 0:
            return None
        square = math.sqrt(inside) - 3 * v2
        if square < 0:
            return None
        mu2 = math.copysign(math.sqrt(square), mu2)
        low = mu1**5 + 10 * v1 * mu1**3 + 15 * v1**2 * mu1
        high = mu2**5 + 10 * v2 * mu2**3 + 15 * v2**2 * mu2
        if abs(low - high) < 1e-15:
            return None
        p = (m5 - high) / (low - high)
    else:
        low, high = 3 * v1**2 + 6 * v1 * mu1**2 + mu1**4, 3 * v2**2 + 6 * v2 * mu2**2 + mu2**4
        if abs(low - high) < 1e-15:
            return None
        p = (m4 - high) / (low - high)
    return (mu1, mu2, math.sqrt(v1), math.sqrt(v2), p) if 0 < p < 1 else None


def fit_moments(moments: list[float], *, epsilon: float = 1e-5, factor: float = 5.0, variant: int = 1, max_iter: int = 10_000, seed: int = 0) -> list[tuple[float, ...]]:
    """(mu1, mu2, s1, s2, p, error): fixed-point steps on p from a random start for each mu2 of a grid, better ones
    appended as they are found."""
    rng = np.random.default_rng(seed)
    sd = math.sqrt(max(centered_moment(moments, 2), 0.0))
    best: list[tuple[float, ...]] = []
    least = math.inf
    for i in range(1, max(2, int(1 / epsilon))):
        mu2, p = moments[0] + i * epsilon * factor * sd, float(rng.uniform(0, 1))
        found = None
        for _ in range(max_iter):
            nxt = _step(moments, mu2, p, variant == 2)
            if nxt is None:
                break
            done = abs(nxt[4] - p) < epsilon
            found, p, mu2 = nxt, nxt[4], nxt[1]
            if done:
                break
        if found:
            error = sum((a - b) ** 2 for a, b in zip(raw_moments(*found), moments, strict=True))
            if error < least:
                least = error
                best.append((*found, error))
    return best


def fit_mixture(spark: SparkSession, moments: list[float], runs: int = 10, **options) -> DataFrame:
    """(run, mu1, mu2, s1, s2, p, error): the best fit of each run, one task for each."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = fit_moments(moments, seed=i, **options)
                if rows:
                    b = rows[-1]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.array([float(v)]) for v in b)], ["run", "mu1", "mu2", "s1", "s2", "p", "error"])

    schema = "run long, mu1 double, mu2 double, s1 double, s2 double, p double, error double"
    return spark.range(0, runs, 1, runs).withColumnRenamed("id", "run").mapInArrow(run, schema)


def likeliest(df: DataFrame, columns: list[str], points: int = 1000) -> DataFrame:
    """(column, value): mode of each column by a Gaussian kernel density on a grid, to 5 decimals. The grid is a bounded
    array, summed per row."""
    out = None
    for c in columns:
        one = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.stddev_samp(c).alias("sd"), F.count(c).alias("n")).first()
        h = (one["sd"] or 0.0) * one["n"] ** -0.2
        if not h:
            mode = df.sparkSession.createDataFrame([(c, round(one["lo"], 5))], "column string, value double")
        else:
            grid = np.linspace(one["lo"], one["hi"], points).tolist()
            each = df.select(F.explode(F.array(*map(F.lit, grid))).alias("g"), F.col(c).alias("v"))
            dens = each.groupBy("g").agg(F.sum(F.exp(-0.5 * F.pow((F.col("g") - F.col("v")) / h, 2))).alias("d"))
            mode = dens.agg(F.round(F.max_by("g", "d"), 5).alias("value")).select(F.lit(c).alias("column"), "value")
        out = mode if out is None else out.unionAll(mode)
    return out


# Integer decisions


@dataclass(frozen=True)
class Variable:
    name: str
    low: int
    high: int
    step: int = 1

    def values(self) -> range:
        if self.step < 1 or self.low > self.high:
            raise ValueError(f"{self.name} has no values")
        return range(self.low, self.high + 1, self.step)


def decision_count(variables: list[Variable]) -> int:
    if not variables:
        raise ValueError("no variables")
    return math.prod(len(v.values()) for v in variables)


def decisions(spark: SparkSession, variables: list[Variable], limit: int = 10_000_000) -> DataFrame:
    """(id, one column for each variable): the whole decision space from its ordinals, in lexicographic order, so rows
    spread over tasks without a product of tables."""
    total = decision_count(variables)
    if total > limit:
        raise ValueError(f"{total} decisions are more than {limit}")
    out, below = spark.range(total), total
    columns = []
    for v in variables:
        n = len(v.values())
        below //= n
        columns.append((F.lit(v.low) + F.lit(v.step) * F.pmod(F.floor(F.col("id") / below), F.lit(n))).cast("long").alias(v.name))
    return out.select("id", *columns)


def solve_exact(spark: SparkSession, variables: list[Variable], objective: Column, *, maximize: bool = True) -> DataFrame:
    """The best decision, the first on ties."""
    scored = decisions(spark, variables).withColumn("objective", objective)
    return scored.orderBy(F.desc("objective") if maximize else F.asc("objective"), "id").limit(1)


def compare_with(exact: float, candidate: float, *, maximize: bool = True) -> float:
    """How far another solver's objective is from the exact one, at least 0."""
    return max(0.0, exact - candidate if maximize else candidate - exact)


def trading_paths(spark: SparkSession, horizon: int, trades: tuple[int, int], inventory: tuple[int, int], *, start: int = 0, terminal: int | None = None, limit: int = 1_000_000) -> DataFrame:
    """(trades, inventories): all paths of `horizon` trades that keep the inventory within its bounds (and end at
    `terminal`)."""
    if horizon < 1 or trades[0] > trades[1] or not inventory[0] <= start <= inventory[1]:
        raise ValueError("the trajectory has no paths")
    empty = F.array().cast("array<bigint>")
    out = spark.range(1).select(empty.alias("trades"), empty.alias("inventories"), F.lit(start).cast("long").alias("_i"))
    steps = F.array(*[F.lit(t).cast("long") for t in range(trades[0], trades[1] + 1)])
    for left in range(horizon - 1, -1, -1):
        out = out.select("*", F.explode(steps).alias("_t")).withColumn("_n", F.col("_i") + F.col("_t")).where(F.col("_n").between(*inventory))
        if terminal is not None:  # what is left can still reach the end
            out = out.where(F.col("_n").between(terminal - left * trades[1], terminal - left * trades[0]))
        out = out.select(F.concat("trades", F.array("_t")).alias("trades"), F.concat("inventories", F.array("_n")).alias("inventories"), F.col("_n").alias("_i"))
    out = out.drop("_i")
    if out.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} paths")
    return out


def path_objective(returns: list[float], *, risk: float = 0.0, impact: float = 0.0, ticket: float = 0.0, terminal: float = 0.0) -> Column:
    """Sum over steps of inventory times return less risk, impact and ticket costs, less a penalty on what is left."""
    r = F.array(*map(F.lit, map(float, returns)))
    steps = F.arrays_zip(F.col("inventories").alias("i"), F.col("trades").alias("t"), r.alias("r"))

    def add(total: Column, s: Column) -> Column:
        inv, trade = s["i"].cast("double"), s["t"].cast("double")
        return total + inv * s["r"] - risk * inv * inv - impact * F.abs(trade) - F.when(trade != 0, ticket).otherwise(0.0)

    last = F.element_at("inventories", -1).cast("double")
    return F.aggregate(steps, F.lit(0.0), add) - terminal * F.abs(last)


def solve_trajectory(paths: DataFrame, objective: Column) -> DataFrame:
    """The best path, the least in order of trades on ties."""
    return paths.withColumn("objective", objective).orderBy(F.desc("objective"), "trades").limit(1)


def solve_with_adapter(variables: list[Variable], objective: Callable[[tuple[int, ...]], float], adapter: Callable) -> tuple[tuple[int, ...], float]:
    """Any solver that takes the variables and an objective and returns a decision."""
    got = tuple(adapter(variables, objective))
    if any(x not in v.values() for x, v in zip(got, variables, strict=True)):
        raise ValueError("the adapter left the decision space")
    return got, objective(got)


def brute_force(variables: list[Variable], objective: Callable[[tuple[int, ...]], float]) -> tuple[int, ...]:
    """A reference adapter."""
    return max(itertools.product(*(v.values() for v in variables)), key=objective)


# Partitions of work


def partition_atoms(n: int, parts: int, strategy: str = "linear") -> list[tuple[int, int]]:
    """Contiguous (start, end) parts: of equal length, or with bounds at square roots so that nested loops cost the same."""
    if n < 0 or parts < 1:
        raise ValueError("need atoms and parts")
    parts = min(parts, max(n, 1))
    if strategy == "linear":
        bounds = [round(i * n / parts) for i in range(parts + 1)]
    elif strategy == "nested":
        bounds = [round((-1 + math.sqrt(1 + 4 * i * n * (n + 1) / parts)) / 2) for i in range(parts + 1)]
        bounds[-1] = n
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return [(a, b) for a, b in itertools.pairwise(bounds) if b > a]


def run_parallel(spark: SparkSession, atoms: list, callback: Callable[[list], float], *, parts: int = 8, strategy: str = "linear") -> list[float]:
    """callback over each part, one task each, results in order."""
    pieces = partition_atoms(len(atoms), parts, strategy)
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pieces)], "part int, a int, b int").repartition(max(1, len(pieces)), "part")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([float(callback(atoms[r["a"] : r["b"]]))])], ["part", "value"])

    return [r["value"] for r in table.mapInArrow(run, "part int, value double").orderBy("part").collect()]


@dataclass
class Dispatched:
    """A parallel run that goes on in the background."""

    future: Future

    def is_finished(self) -> bool:
        return self.future.done()

    def wait(self, timeout: float | None = None) -> list[float]:
        """Results in order; an error of a part is raised here."""
        return self.future.result(timeout)


def dispatch(spark: SparkSession, atoms: list, callback: Callable[[list], float], *, parts: int = 8, strategy: str = "linear") -> Dispatched:
    """run_parallel on a thread of its own; Spark schedules its job beside others."""
    pool = ThreadPoolExecutor(1)
    future = pool.submit(run_parallel, spark, atoms, callback, parts=parts, strategy=strategy)
    pool.shutdown(wait=False)
    return Dispatched(future)
