"""Time joins without nested loops: as-of joins by windows, range joins by buckets, span counts by a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import INFINITY, NAN


def asof_forward(left: DataFrame, right: DataFrame, at: Column, *, value: str = "ts", by: str = "symbol", name: str = "found") -> DataFrame:
    """`left` with the first `right.value` at or after `at` (null if there is none): one sort of both sides together."""
    rows = left.select(F.struct(*left.columns).alias("_row"), F.col(by).alias("_by"), at.alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    marks = right.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(by).alias("_by"), F.col(value).alias("_at"), F.col(value).alias("_v"))
    # from late to early, marks before rows of the same time: a running frame, which costs a step for each row
    w = Window.partitionBy("_by").orderBy(F.desc("_at"), F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).select("_row", F.last("_v", True).over(w).alias(name))
    return both.where(F.col("_row").isNotNull()).select("_row.*", name)


def range_join(spans: DataFrame, points: DataFrame, *, start: str, end: str, at: str, by: str = "symbol", bucket_seconds: int = 86_400, open_start: bool = False) -> DataFrame:
    """Pairs of spans and points with start <= at <= end (start < at with `open_start`): an equi join on (by, bucket), to
    which a span goes once for each bucket that it touches."""

    def bucket(c: str) -> Column:
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))

    wide = spans.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    keyed = points.withColumn("_b", bucket(at))
    joined = wide.join(keyed, [by, "_b"]).drop("_b")
    after = F.col(at) > F.col(start) if open_start else F.col(at) >= F.col(start)
    return joined.where(after & (F.col(at) <= F.col(end)))


def concurrency(points: DataFrame, spans: DataFrame, *, start: str = "start", end: str = "end", at: str = "ts", by: str = "symbol", name: str = "concurrent", end_open: bool = False) -> DataFrame:
    """`points` with the number of closed spans that cover each: +1 where a span starts and -1 after it ends, summed in
    order of time. Opening counts before a point at the same time, closing after it (before it with `end_open`)."""
    live = spans.where(F.col(start) <= F.col(end))
    opening = live.select(F.col(by).alias("_by"), F.col(start).alias("_t"), F.lit(1).alias("_d"), F.lit(0).alias("_k"))
    closing = live.select(F.col(by).alias("_by"), F.col(end).alias("_t"), F.lit(-1).alias("_d"), F.lit(-1 if end_open else 2).alias("_k"))
    moves = opening.unionAll(closing).groupBy("_by", "_t", "_k").agg(F.sum("_d").alias("_d"))
    row = F.struct(*points.columns)
    marks = points.select(F.col(by).alias("_by"), F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_d"), row.alias("_row"))
    moves = moves.select("_by", "_t", "_k", "_d", F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("_by").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(moves).select("_row", F.sum("_d").over(w).alias(name))
    return counted.where(F.col("_row").isNotNull()).select("_row.*", name)


def span_sums(spans: DataFrame, points: DataFrame, value: str, *, key: list[str], start: str = "start", end: str = "end", at: str = "ts", by: str = "symbol", open_start: bool = False) -> DataFrame:
    """(key, total, n): sum of `value` and number of points with start <= at <= end of each span (start < at with
    `open_start`), from running sums at both ends, so no span meets its points. Values that are not finite are counted beside the sums, as
    they would stay in them. Spans without points are left out."""
    odd = {"_nan": F.isnan("_v"), "_up": F.col("_v") == INFINITY, "_down": F.col("_v") == -INFINITY}
    none = F.lit(None).cast(spans.select(F.struct(*key).alias("k")).schema["k"].dataType)
    rows = points.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(at).alias("_t"), F.lit(1).alias("_o"), none.alias("_key"), F.lit(0).alias("_sign"), F.col(value).alias("_v"), F.lit(1).alias("_n"))
    live = spans.where(F.col(start) <= F.col(end))
    edges = [(start, 2 if open_start else 0, -1), (end, 2, 1)]  # before or after the points at the same time
    for when, order, sign in edges:
        edge = live.select(F.col(by).alias("_by"), F.col(when).alias("_t"), F.lit(order).alias("_o"), F.struct(*key).alias("_key"), F.lit(sign).alias("_sign"), F.lit(0.0).alias("_v"), F.lit(0).alias("_n"))
        rows = rows.unionByName(edge)
    w = Window.partitionBy("_by").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: test.cast("int") for c, test in odd.items()})
    rows = rows.withColumn("_v", F.when(F.col("_nan") + F.col("_up") + F.col("_down") == 0, F.col("_v")).otherwise(0.0))
    summed = ["_v", "_n", *odd]
    run = rows.select("_key", "_sign", *[F.sum(c).over(w).alias(c) for c in summed]).where(F.col("_key").isNotNull())
    out = run.groupBy("_key").agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in summed])
    none = (F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0))
    total = F.when(none, NAN).when(F.col("_up") > 0, INFINITY).when(F.col("_down") > 0, -INFINITY).otherwise(F.col("_v"))
    return out.where(F.col("_n") > 0).select("_key.*", total.alias("total"), F.col("_n").alias("n"))
