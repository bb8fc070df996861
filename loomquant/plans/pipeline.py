"""The mid-frequency research pipeline as one plan per stage, and the research flywheel on top of it.

Inputs are frames: bars (symbol, ts, ord, close, prob[, side]) and asset prices (ts, asset, price). Every symbol runs
through the same plan at once; only the weights are solved on the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bet_sizing import discrete_signal, get_signal
from ..operators import portfolio, stats
from ..operators.filters import cusum_filter


@dataclass(frozen=True)
class PipelineConfig:
    cusum_threshold: float = 0.001
    num_classes: int = 2
    step_size: float = 0.1
    risk_free_rate: float = 0.0
    confidence_level: float = 0.05

    def __post_init__(self) -> None:
        if not (self.cusum_threshold > 0 and np.isfinite(self.cusum_threshold)):
            raise ValueError("cusum_threshold must be finite and positive")
        if self.num_classes < 2 or not 0 <= self.confidence_level <= 1:
            raise ValueError("num_classes must be 2 or more and confidence_level within [0, 1]")


def _w():
    return Window.partitionBy("symbol").orderBy("ts", "ord")


def select_events(bars: DataFrame, config: PipelineConfig) -> DataFrame:
    """(symbol, ts, ord, prob, side) where the CUSUM filter fires."""
    side = F.col("side") if "side" in bars.columns else F.lit(1.0)
    fired = cusum_filter(bars.select("symbol", "ts", "ord", "close"), config.cusum_threshold).select("symbol", "ts", "ord")
    return fired.join(bars.select("symbol", "ts", "ord", "prob", side.alias("side")), ["symbol", "ts", "ord"])


def event_signals(events: DataFrame, config: PipelineConfig) -> DataFrame:
    raw = get_signal(F.col("prob"), config.num_classes, F.col("side"))
    return events.select("symbol", "ts", "ord", discrete_signal(raw, config.step_size).alias("signal"))


def signal_timeline(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """(symbol, ts, ord, close, signal): the last event's signal, 0 before the first."""
    joined = bars.select("symbol", "ts", "ord", "close").join(signals, ["symbol", "ts", "ord"], "left")
    filled = F.last("signal", True).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("signal", F.coalesce(filled, F.lit(0.0)))


def strategy_path(timeline: DataFrame) -> DataFrame:
    """(symbol, ts, ord, position, ret, equity): the return of each bar on the signal before it, compounded; the first
    bar's return is null."""
    before, held = F.lag("close").over(_w()), F.lag("signal").over(_w())
    rows = timeline.select("symbol", "ts", "ord", F.col("signal").alias("position"), (held * (F.try_divide(F.col("close"), before) - 1)).alias("ret"))
    grown = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("equity", grown)


def risk_summary(path: DataFrame, config: PipelineConfig) -> DataFrame:
    """(symbol, value_at_risk, expected_shortfall, conditional_drawdown_risk, realized_sharpe)."""
    returns = path.where(F.col("ret").isNotNull()).select("symbol", "ts", "ret")
    tail = stats.tail_risk(returns, config.confidence_level)
    cdar = stats.conditional_drawdown_risk(returns, config.confidence_level).withColumnRenamed("cdar", "conditional_drawdown_risk")
    sharpe = stats.sharpe_ratio(returns, 252.0, config.risk_free_rate).withColumnRenamed("sharpe", "realized_sharpe")
    return tail.join(cdar, "symbol").join(sharpe, "symbol")


def leakage_checks(bars: DataFrame, timeline: DataFrame, path: DataFrame) -> DataFrame:
    """One row, from the data: every bar has one position, positions are at events' order, and no bar's return uses its
    own or a later signal."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n")).join(path.groupBy("symbol").agg(F.count("*").alias("m")), "symbol", "full")
    aligned = counts.agg(F.coalesce(F.every(F.col("n").eqNullSafe(F.col("m"))), F.lit(True)).alias("inputs_aligned"))
    held = timeline.select("symbol", "ts", "ord", F.lag("signal").over(_w()).alias("_h"), (F.try_divide(F.col("close"), F.lag("close").over(_w())) - 1).alias("_m"))
    looked = path.join(held, ["symbol", "ts", "ord"]).agg(
        F.coalesce(F.some(F.abs(F.col("ret") - F.col("_h") * F.col("_m")) > 1e-12), F.lit(False)).alias("has_forward_look_bias")
    )
    sorted_ = timeline.select((F.lag("ts").over(_w()) > F.col("ts")).alias("_x")).agg((~F.coalesce(F.some("_x"), F.lit(False))).alias("event_indices_sorted"))
    return aligned.crossJoin(sorted_).crossJoin(looked)


@dataclass
class PipelineResult:
    events: DataFrame
    signals: DataFrame
    path: DataFrame
    drawdowns: DataFrame
    risk: DataFrame
    leakage: DataFrame
    portfolio: portfolio.Allocation

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row for each symbol with portfolio, risk and leakage figures."""
        p = self.portfolio
        row = spark.createDataFrame([(p.sharpe, p.expected, p.risk)], "portfolio_sharpe double, portfolio_return double, portfolio_risk double")
        return self.risk.crossJoin(F.broadcast(row)).crossJoin(F.broadcast(self.leakage))


def run_pipeline(bars: DataFrame, asset_prices: DataFrame, config: PipelineConfig) -> PipelineResult:
    events = select_events(bars, config)
    signals = event_signals(events, config)
    timeline = signal_timeline(bars, signals)
    path = strategy_path(timeline)
    drawdowns = stats.drawdown_and_time_under_water(path.select("symbol", "ts", F.col("equity").alias("value")))
    weights = portfolio.allocate(asset_prices, "max_sharpe", risk_free=config.risk_free_rate)
    return PipelineResult(events, signals, path, drawdowns, risk_summary(path, config), leakage_checks(bars, timeline, path), weights)


# Flywheel


@dataclass(frozen=True)
class FlywheelConfig:
    pipeline: PipelineConfig = PipelineConfig()
    commission_bps: float = 1.5
    spread_bps: float = 2.0
    slippage_vol_mult: float = 8.0
    min_net_sharpe: float = 0.30
    min_realized_sharpe: float = 0.25

    def with_values(self, **values) -> FlywheelConfig:
        inner = {k: v for k, v in values.items() if k in PipelineConfig.__dataclass_fields__}
        return replace(self, pipeline=replace(self.pipeline, **inner), **{k: v for k, v in values.items() if k not in inner})

    def digest(self) -> str:
        """First 12 hex digits of the hash of the sorted configuration."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def costs(path: DataFrame, config: FlywheelConfig) -> DataFrame:
    """(symbol, turnover, realized_vol, estimated_cost, gross_total_return, net_total_return, net_sharpe,
    cost_adjusted_sharpe): turnover times commission, spread and slippage. net_sharpe is of the gross returns, as the gates
    expect it; cost_adjusted_sharpe takes each bar's costs off first."""
    w = _w()
    moved = F.abs(F.col("position") - F.lag("position").over(w))
    rows = path.select("symbol", "ts", "ord", "equity", F.coalesce("ret", F.lit(0.0)).alias("r"), F.coalesce(moved, F.lit(0.0)).alias("d"))
    s = rows.groupBy("symbol").agg(
        F.sum("d").alias("turnover"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("_sd"), F.avg("r").alias("_m"), F.count("*").alias("_n"),
        F.max_by("equity", F.struct("ts", "ord")).alias("_e"),
    )
    vol = F.col("_sd") * 252.0**0.5
    per_turn = config.commission_bps * 1e-4 + config.spread_bps * 1e-4 + config.slippage_vol_mult * vol * 1e-3
    year = F.sqrt(252.0 * 390.0 / F.greatest("_n", F.lit(1)))
    s = s.withColumn("_pt", per_turn).withColumn("_y", year)
    net = rows.join(s.select("symbol", "_pt"), "symbol").withColumn("x", F.col("r") - F.col("d") * F.col("_pt"))
    adjusted = net.groupBy("symbol").agg(F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x")), F.lit(0.0)).alias("_a"))
    s = s.join(adjusted, "symbol")
    return s.select(
        "symbol", "turnover", vol.alias("realized_vol"), (F.col("turnover") * F.col("_pt")).alias("estimated_cost"), (F.col("_e") - 1).alias("gross_total_return"),
        (F.col("_e") - 1 - F.col("turnover") * F.col("_pt")).alias("net_total_return"), (F.coalesce(F.try_divide(F.col("_m"), F.col("_sd")), F.lit(0.0)) * F.col("_y")).alias("net_sharpe"),
        (F.col("_a") * F.col("_y")).alias("cost_adjusted_sharpe"),
    )


def run_flywheel(bars: DataFrame, asset_prices: DataFrame, config: FlywheelConfig) -> DataFrame:
    """One row for each symbol: summary, costs and promotion gates."""
    result = run_pipeline(bars, asset_prices, config.pipeline)
    table = result.summary(bars.sparkSession).join(costs(result.path, config), "symbol")
    gates = table.withColumns(
        {
            "passed_realized_sharpe": F.coalesce(F.col("realized_sharpe") >= config.min_realized_sharpe, F.lit(False)),
            "passed_net_sharpe": F.col("net_sharpe") >= config.min_net_sharpe,
            "passed_alignment_guard": F.col("inputs_aligned"),
            "passed_event_order_guard": F.col("event_indices_sorted"),
        }
    )
    passed = F.col("passed_realized_sharpe") & F.col("passed_net_sharpe") & F.col("passed_alignment_guard") & F.col("passed_event_order_guard")
    return gates.withColumn("promote_candidate", passed)


def run_grid(bars: DataFrame, asset_prices: DataFrame, configs: dict[str, dict], base: FlywheelConfig = FlywheelConfig()) -> DataFrame:
    """The leaderboard over named configurations: promoted first, then by net and realized Sharpe ratio."""
    if not configs:
        raise ValueError("no configurations")
    out = None
    for i, (name, values) in enumerate(configs.items()):
        config = base.with_values(**values)
        rows = run_flywheel(bars, asset_prices, config).select(F.lit(name).alias("run_name"), F.lit(i).alias("run_index"), F.lit(config.digest()).alias("config_digest"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("promote_candidate"), F.desc("net_sharpe"), F.desc("realized_sharpe"), "run_index", "symbol")


def synthetic_dataset(spark: SparkSession, n_bars: int = 192, seed: int = 7, assets: tuple[str, ...] = ("CL", "NG", "RB", "GC")) -> tuple[DataFrame, DataFrame]:
    """Bars with model probabilities and sides, and asset prices; the same for the same seed."""
    rng = np.random.default_rng(seed)
    steps = rng.normal(0.00005, 0.0012, (n_bars, len(assets))) + rng.normal(0, 0.0006, (n_bars, 1))
    prices = 100 * np.exp(np.cumsum(steps, axis=0))
    momentum = np.concatenate([[0.0], np.sign(np.diff(prices[:, 0]))])
    prob = np.clip(0.5 + 0.1 * rng.random(n_bars) + 0.05 * momentum, 0.05, 0.95)
    start = np.datetime64("2024-01-01T09:30:00")
    stamps = [(start + np.timedelta64(i, "m")).astype("datetime64[us]").item() for i in range(n_bars)]
    side = np.where(momentum >= 0, 1.0, -1.0)
    bars = [(assets[0], stamps[i], i, float(prices[i, 0]), float(prob[i]), float(side[i])) for i in range(n_bars)]
    long = [(stamps[i], a, float(prices[i, j])) for i in range(n_bars) for j, a in enumerate(assets)]
    return (
        spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, ord int, close double, prob double, side double"),
        spark.createDataFrame(long, "ts timestamp_ntz, asset string, price double"),
    )
