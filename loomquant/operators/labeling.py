"""Triple-barrier labels over closes (symbol, ts, close) and events (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timejoin import asof_forward, range_join


def add_vertical_barrier(events: DataFrame, close: DataFrame, *, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> DataFrame:
    """(symbol, ts, t1): the first close at or after the event plus the offset; events without one drop out."""
    offset = days * 86_400 + hours * 3_600 + minutes * 60 + seconds
    at = F.col("ts") + F.expr(f"INTERVAL '{offset}' SECOND")
    found = asof_forward(events.select("symbol", "ts"), close.select("symbol", "ts"), at, name="t1")
    return found.where(F.col("t1").isNotNull())


def triple_barrier_events(
    close: DataFrame,
    events: DataFrame,
    target: DataFrame,
    *,
    profit_taking: float = 1.0,
    stop_loss: float = 1.0,
    min_ret: float = 0.0,
    barriers: DataFrame | None = None,
    side: DataFrame | None = None,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """(symbol, ts, t1, trgt, side): events that are closes with a target above `min_ret` (and a side, if sides are
    given); t1 is the first touch of a barrier, the vertical barrier, or the last close."""
    keys = ["symbol", "ts"]
    kept = events.select(*keys).join(close.select(*keys, F.col("close").alias("_p0")), keys)
    kept = kept.join(target.select(*keys, F.col("trgt")).where(F.col("trgt") > min_ret), keys)
    kept = kept.join(side.select(*keys, "side"), keys) if side is not None else kept.withColumn("side", F.lit(None).cast("double"))
    vertical = barriers.select(*keys, F.col("t1").alias("_v")) if barriers is not None else None
    kept = kept.join(vertical, keys, "left") if vertical is not None else kept.withColumn("_v", F.lit(None).cast("timestamp_ntz"))
    last = close.groupBy("symbol").agg(F.max("ts").alias("_last"))
    kept = kept.join(last, "symbol").withColumn("_end", F.coalesce("_v", "_last"))
    path = range_join(
        kept.withColumnRenamed("ts", "_start"), close.select("symbol", "ts", "close"), start="_start", end="_end", at="ts", open_start=True, bucket_seconds=bucket_seconds
    )
    move = F.coalesce("side", F.lit(1.0)) * (F.try_divide(F.col("close"), F.col("_p0")) - 1)
    hits = F.lit(False)
    if profit_taking > 0:
        hits = hits | (move >= profit_taking * F.col("trgt"))
    if stop_loss > 0:
        hits = hits | (move <= -stop_loss * F.col("trgt"))
    touched = path.where(hits).groupBy("symbol", F.col("_start").alias("ts")).agg(F.min("ts").alias("_touch"))
    out = kept.join(touched, keys, "left")
    return out.select(*keys, F.least("_end", F.coalesce("_touch", "_end")).alias("t1"), "trgt", "side")


def triple_barrier_labels(events: DataFrame, close: DataFrame) -> DataFrame:
    """(symbol, ts, ret, trgt, label, side): the label is the sign of the return, or 1 for a gain and 0 otherwise where
    there is a side."""
    p0 = close.select("symbol", "ts", F.col("close").alias("_p0"))
    p1 = close.select("symbol", F.col("ts").alias("t1"), F.col("close").alias("_p1"))
    joined = events.join(p0, ["symbol", "ts"]).join(p1, ["symbol", "t1"])
    ret = F.coalesce("side", F.lit(1.0)) * (F.try_divide(F.col("_p1"), F.col("_p0")) - 1)
    priced = joined.withColumn("ret", ret)
    label = F.when(F.col("side").isNotNull(), (F.col("ret") > 0).cast("int")).otherwise(F.signum("ret").cast("int"))
    return priced.select("symbol", "ts", "ret", "trgt", label.alias("label"), "side")


def meta_labels(events: DataFrame, close: DataFrame) -> DataFrame:
    """Labels of the events that have a side."""
    return triple_barrier_labels(events.where(F.col("side").isNotNull()), close)


def drop_labels(labeled: DataFrame, min_pct: float = 0.05) -> DataFrame:
    """Drops the rarest label (the smallest on ties) while its share is `min_pct` or less and three or more remain."""
    counts = {r["label"]: r["n"] for r in labeled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    while len(counts) >= 3:
        rarest = min(counts, key=lambda k: (counts[k], k))
        if counts[rarest] / sum(counts.values()) > min_pct:
            break
        del counts[rarest]
    return labeled.where(F.col("label").isin(*counts)) if counts else labeled


get_events = triple_barrier_events
get_bins = triple_barrier_labels
