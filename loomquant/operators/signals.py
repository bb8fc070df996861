"""Bet sizing over events: average active signals, budget and reserve sizes, strategy failure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bet_sizing import discrete_signal, get_signal, single_bet_size_mixed
from ..functions.normal import norm_cdf, norm_ppf
from .timejoin import concurrency


def average_active_signals(events: DataFrame) -> DataFrame:
    """(symbol, ts, signal): at every start and end, the mean signal of the events with start <= ts < end, 0 if none. A
    sweep over the moves, so overlapping events are never paired."""
    points = events.select("symbol", F.col("start").alias("ts")).unionAll(events.select("symbol", F.col("end").alias("ts"))).distinct()
    live = events.where(F.col("start") < F.col("end"))
    opens = live.select("symbol", F.col("start").alias("ts"), F.col("signal").alias("d"), F.lit(1).alias("n"))
    closes = live.select("symbol", F.col("end").alias("ts"), (-F.col("signal")).alias("d"), F.lit(-1).alias("n"))
    moves = opens.unionAll(closes).groupBy("symbol", "ts").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    joined = points.join(moves, ["symbol", "ts"], "left")
    total, count = F.sum(F.coalesce("d", F.lit(0.0))).over(w), F.sum(F.coalesce("n", F.lit(0))).over(w)
    return joined.select("symbol", "ts", F.when(count > 0, total / count).otherwise(0.0).alias("signal"))


def bet_size_probability(events: DataFrame, num_classes: int = 2, step_size: float = 0.0, average_active: bool = False) -> DataFrame:
    """(symbol, ts, size) of events (symbol, start, end, prob, side)."""
    signal = events.withColumn("signal", get_signal(F.col("prob"), num_classes, F.col("side")))
    rows = average_active_signals(signal) if average_active else signal.select("symbol", F.col("start").alias("ts"), "signal")
    return rows.select("symbol", "ts", discrete_signal(F.col("signal"), abs(step_size)).alias("size"))


def concurrent_sides(events: DataFrame) -> DataFrame:
    """(symbol, id, start, active_long, active_short): events alive when each event starts, its own included."""
    points = events.select("symbol", "id", F.col("start").alias("ts"))
    long = concurrency(points, events.where(F.col("side") > 0).where(F.col("start") < F.col("end")), name="active_long", end_open=True)
    both = concurrency(long, events.where(~(F.col("side") > 0)).where(F.col("start") < F.col("end")), name="active_short", end_open=True)
    return both.select("symbol", "id", F.col("ts").alias("start"), F.coalesce("active_long", F.lit(0)).alias("active_long"), F.coalesce("active_short", F.lit(0)).alias("active_short"))


def bet_size_budget(events: DataFrame) -> DataFrame:
    """(symbol, id, size): active longs over their maximum less active shorts over theirs."""
    sides = concurrent_sides(events)
    most = sides.groupBy("symbol").agg(F.max("active_long").alias("ml"), F.max("active_short").alias("ms"))
    part = [F.when(F.col(m) > 0, F.col(a) / F.col(m)).otherwise(0.0) for a, m in (("active_long", "ml"), ("active_short", "ms"))]
    return sides.join(most, "symbol").select("symbol", "id", (part[0] - part[1]).alias("size"))


def fit_two_normals(values: np.ndarray, counts: np.ndarray, *, runs: int = 100, epsilon: float = 1e-5, iterations: int = 200, seed: int = 0) -> tuple[float, ...]:
    """(mu1, mu2, sigma1, sigma2, p1) by expectation maximisation over distinct values with their counts, the best of
    several starts."""
    rng = np.random.default_rng(seed)
    w = counts / counts.sum()
    sd = np.sqrt((w * (values - (w * values).sum()) ** 2).sum()) or 1.0
    mu = rng.choice(values, (runs, 2)) + rng.normal(0, 0.1 * sd, (runs, 2))
    sigma, p = np.full((runs, 2), sd), rng.uniform(0.3, 0.7, runs)
    last, going = np.full(runs, -np.inf), np.ones(runs, dtype=bool)
    v, share_of = values[None, :, None], w[None, :, None]
    for _ in range(iterations):  # all starts at once; one that has settled is left as it is
        m, s = mu[going, None, :], sigma[going, None, :]
        z = (v - m) / s
        dens = np.exp(-0.5 * z * z) / (s * np.sqrt(2 * np.pi)) * np.stack([p[going], 1 - p[going]], axis=1)[:, None, :]
        total = dens.sum(axis=2) + 1e-300
        ll = (w * np.log(total)).sum(axis=1)
        share = dens / total[:, :, None] * share_of
        mass = share.sum(axis=1) + 1e-300
        mu[going] = (share * v).sum(axis=1) / mass
        sigma[going] = np.maximum(np.sqrt((share * (v - mu[going, None, :]) ** 2).sum(axis=1) / mass), 1e-4 * sd)
        p[going] = mass[:, 0] / mass.sum(axis=1)
        settled = np.abs(ll - last[going]) < epsilon
        last[going] = ll
        going[np.flatnonzero(going)[settled]] = False
        if not going.any():
            break
    best = int(np.argmax(last))
    mu, sigma, p = mu[best], sigma[best], float(p[best])
    order = np.argsort(mu)
    return float(mu[order[0]]), float(mu[order[1]]), float(sigma[order[0]]), float(sigma[order[1]]), p if order[0] == 0 else 1 - p


def fit_reserve(events: DataFrame, **options) -> tuple[float, ...]:
    """Mixture of the signed concurrency. The driver gets one row for each distinct value, of which there are as many as
    levels of concurrency."""
    sides = concurrent_sides(events).select((F.col("active_long") - F.col("active_short")).alias("c"))
    rows = sides.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()
    return fit_two_normals(np.array([float(r["c"]) for r in rows]), np.array([float(r["n"]) for r in rows]), **options)


def bet_size_reserve(events: DataFrame, fit: tuple[float, ...]) -> DataFrame:
    """(symbol, id, active_long, active_short, c, size)."""
    sides = concurrent_sides(events).withColumn("c", (F.col("active_long") - F.col("active_short")).cast("double"))
    return sides.select("symbol", "id", "active_long", "active_short", "c", single_bet_size_mixed(F.col("c"), fit).alias("size"))


def strategy_failure(outcomes: DataFrame, *, target_sharpe: float, years: float, horizon: float = 2.0, draws: int = 500) -> DataFrame:
    """(symbol, win, loss, precision, frequency, needed, empirical, smoothed): probability that bootstrapped precision is
    at or below what the target Sharpe ratio needs. A bootstrap of win flags is a binomial draw, so no row is resampled; its
    normal limit, cut to [0, 1], is taken at `draws` evenly spaced quantiles, so nothing is random."""
    from ..functions.sharpe import implied_precision_asymmetric

    v = F.col("ret")
    base = outcomes.groupBy("symbol").agg(F.avg(F.when(v > 0, v)).alias("win"), F.avg(F.when(v <= 0, v)).alias("loss"), F.avg((v > 0).cast("double")).alias("precision"), F.count("*").alias("n"))
    base = base.withColumn("frequency", F.col("n") / years)
    base = base.withColumn("needed", implied_precision_asymmetric(F.lit(target_sharpe), F.col("frequency"), F.col("win"), F.col("loss")))
    size = F.greatest(F.lit(1.0), F.floor(F.col("frequency") * horizon))
    drawn = base.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = drawn.withColumn("_u", (F.col("_i") - 0.5) / float(draws))
    noise = F.sqrt(F.col("precision") * (1 - F.col("precision")) / size) * norm_ppf("_u")
    drawn = drawn.withColumn("_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("precision") + noise)))
    keys = ["symbol", "win", "loss", "precision", "frequency", "needed"]
    moments = drawn.groupBy("symbol").agg(F.greatest(1.06 * F.stddev_samp("_p") * draws**-0.2, F.lit(1e-3)).alias("_h"))
    joined = drawn.join(moments, "symbol")
    return joined.groupBy(*keys).agg(
        F.avg((F.col("_p") <= F.col("needed")).cast("double")).alias("empirical"),
        F.avg(norm_cdf((F.col("needed") - F.col("_p")) / F.col("_h"))).alias("smoothed"),
    )
