"""Early warning over event streams: volume-synchronised order imbalance and venue concentration.

The same state machine runs as a stateful stream (state per stream id) and as a batch replay.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT = "stream string, ord long, vpin double, hhi double, score double, alert boolean"


@dataclass(frozen=True)
class WarningConfig:
    bucket_volume: float = 1000.0
    support_buckets: int = 20
    lookback_events: int = 200
    vpin_threshold: float = 0.45
    hhi_threshold: float = 0.30

    def __post_init__(self) -> None:
        numbers = (self.bucket_volume, self.vpin_threshold, self.hhi_threshold)
        if not all(np.isfinite(v) and v > 0 for v in numbers):
            raise ValueError("volumes and thresholds must be finite and positive")
        if self.support_buckets < 1 or self.lookback_events < 1:
            raise ValueError("windows must hold something")


class WarningState:
    """Both windows of one stream; their length is bounded by the configuration."""

    def __init__(self, config: WarningConfig):
        self.config = config
        self.filled = self.imbalance = 0.0
        self.buckets: deque[float] = deque()
        self.bucket_sum = 0.0
        self.venues: deque[int] = deque()
        self.counts: dict[int, int] = {}
        self.squares = 0

    @property
    def completed_buckets(self) -> int:
        """Full buckets in the window."""
        return len(self.buckets)

    @property
    def window_length(self) -> int:
        """Events in the venue window."""
        return len(self.venues)

    def vpin(self, buy: float, sell: float) -> float | None:
        """One event may fill several buckets; the imbalance is summed over the pieces."""
        c = self.config
        left = buy + sell
        share_buy = buy / left
        while left > 0:
            piece = min(left, c.bucket_volume - self.filled)
            self.filled += piece
            self.imbalance += abs(piece * share_buy - piece * (1 - share_buy))
            left -= piece
            if left < 1e-12:
                left = 0.0
            if self.filled >= c.bucket_volume - 1e-12:
                value = self.imbalance / c.bucket_volume
                self.buckets.append(value)
                self.bucket_sum += value
                if len(self.buckets) > c.support_buckets:
                    self.bucket_sum -= self.buckets.popleft()
                self.filled = self.imbalance = 0.0
        return self.bucket_sum / c.support_buckets if len(self.buckets) == c.support_buckets else None

    def hhi(self, venue: int) -> float | None:
        n = self.counts.get(venue, 0)
        self.squares += 2 * n + 1
        self.counts[venue] = n + 1
        self.venues.append(venue)
        if len(self.venues) > self.config.lookback_events:
            old = self.venues.popleft()
            m = self.counts[old]
            self.squares -= 2 * m - 1
            self.counts[old] = m - 1
            if m == 1:
                del self.counts[old]
        full = len(self.venues) == self.config.lookback_events
        return self.squares / self.config.lookback_events**2 if full else None

    def on_event(self, buy: float, sell: float, venue: int) -> tuple:
        v, h = self.vpin(buy, sell), self.hhi(venue)
        c = self.config
        score = 0.5 * (v / c.vpin_threshold + h / c.hhi_threshold) if v is not None and h is not None else None
        alert = score is not None and v >= c.vpin_threshold and h >= c.hhi_threshold
        return v, h, score, bool(alert)


def valid(price: str = "price", buy: str = "buy_volume", sell: str = "sell_volume"):
    """Events with a finite positive price and finite volumes that are not negative nor both 0."""
    p, b, s = F.col(price), F.col(buy), F.col(sell)
    finite = ~F.isnan(p) & ~F.isnan(b) & ~F.isnan(s) & (p < float("inf")) & (b < float("inf")) & (s < float("inf"))
    return F.coalesce(finite & (p > 0) & (b >= 0) & (s >= 0) & (b + s > 0), F.lit(False))


def _snapshots(state: WarningState, stream: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = [state.on_event(b, s, int(v)) for b, s, v in zip(rows["buy_volume"], rows["sell_volume"], rows["venue"], strict=True)]
    frame = pd.DataFrame(out, columns=["vpin", "hhi", "score", "alert"]).astype({"vpin": float, "hhi": float, "score": float})
    frame.insert(0, "ord", rows["ord"].to_numpy())
    frame.insert(0, "stream", stream)
    return frame


def checked(events: DataFrame, strict: bool) -> DataFrame:
    """Valid events; with `strict` an invalid one is an error, otherwise it is left out (`valid` counts them)."""
    if not strict:
        return events.where(valid())
    wrong = F.raise_error(F.concat(F.lit("invalid event "), F.coalesce(F.col("ord").cast("string"), F.lit("without a number")))).cast("boolean")
    return events.where(F.when(valid(), True).otherwise(wrong))


def replay(events: DataFrame, config: WarningConfig, *, strict: bool = False) -> DataFrame:
    """Snapshots (stream, ord, vpin, hhi, score, alert) of a finished table (stream, ord, price, buy_volume, sell_volume,
    venue); invalid events are left out, or with `strict` an error."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _snapshots(WarningState(config), key[0], rows.sort_values("ord"))

    columns = ["stream", "ord", "buy_volume", "sell_volume", "venue"]
    return checked(events, strict).select(*columns).groupBy("stream").applyInPandas(run, OUTPUT)


def watch(events: DataFrame, config: WarningConfig, *, strict: bool = False, idle_minutes: int | None = None) -> DataFrame:
    """The same over a stream: state is kept for each stream id, rows of a micro-batch are taken in order of `ord`, and
    micro-batches as they come. With `idle_minutes` the state of a stream id that has been silent for so long is dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else WarningState(config)
        rows = pd.concat(list(parts)).sort_values("ord")
        yield _snapshots(held, key[0], rows)
        state.update((pickle.dumps(held),))
        if idle_minutes:
            state.setTimeoutDuration(60_000 * idle_minutes)

    columns = ["stream", "ord", "buy_volume", "sell_volume", "venue"]
    grouped = checked(events, strict).select(*columns).groupBy("stream")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return grouped.applyInPandasWithState(run, OUTPUT, "held binary", "append", timeout)


def summary(snapshots: DataFrame) -> DataFrame:
    """(stream, events, alerts, vpin, hhi, score): counts and the last snapshot of each stream."""
    last = F.max_by(F.struct("vpin", "hhi", "score"), "ord")
    s = snapshots.groupBy("stream").agg(F.count("*").alias("events"), F.count_if("alert").alias("alerts"), last.alias("l"))
    return s.select("stream", "events", "alerts", "l.vpin", "l.hhi", "l.score")


def synthetic_crash(spark: SparkSession, n: int, *, crash_fraction: float = 0.7, venues: int = 8, shock_venue: int = 0) -> DataFrame:
    """A calm regime, then a shock: prices are closed forms of the number of events in each, so rows need no order."""
    calm = int(n * crash_fraction)
    i = F.col("id")
    shock = i >= calm
    price = 100 * F.pow(F.lit(1.0001), F.least(i + 1, F.lit(calm))) * F.pow(F.lit(0.9975), F.greatest(i + 1 - calm, F.lit(0)))
    return spark.range(n).select(
        F.lit("synthetic").alias("stream"), i.alias("ord"), (i * 1_000_000).alias("timestamp_ns"), price.alias("price"),
        F.when(shock, 80.0).otherwise(120.0).alias("buy_volume"), F.when(shock, 320.0).otherwise(130.0).alias("sell_volume"),
        F.when(shock, shock_venue).otherwise(i % venues).cast("long").alias("venue"),
    )
