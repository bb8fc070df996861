"""ETF trick and futures rolls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_wide_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(date, security, value) of a wide CSV: the first column is the index, the others are securities."""
    wide = spark.read.option("header", True).csv(path)
    if len(wide.columns) < 2:
        raise ValueError("a wide table needs an index and a column")
    index, *rest = wide.columns
    typed = wide.select(F.col(index).alias("date"), *[F.col(c).try_cast("double").alias(c) for c in rest])
    return typed.unpivot("date", rest, "security", value)


def join_tables(open_: DataFrame, close: DataFrame, alloc: DataFrame, costs: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Long tables with the same (date, security) keys as one; a key that a table lacks fails."""
    keys = ["date", "security"]
    out = open_.join(close, keys, "full").join(alloc, keys, "full").join(costs, keys, "full")
    out = out.join(rates, keys, "full") if rates is not None else out.withColumn("rate", F.lit(1.0))
    bad = F.col("open").isNull() | F.col("close").isNull() | F.col("alloc").isNull() | F.col("cost").isNull() | F.col("rate").isNull()
    return out.withColumn("open", F.when(bad, F.raise_error(F.lit("the tables differ in their keys")).cast("double")).otherwise(F.col("open")))


def etf_values(open_: np.ndarray, close: np.ndarray, alloc: np.ndarray, cost: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Value of one unit held as the allocation says (rows are dates): the first output belongs to the second row and is
    1, the last row gives none. Holdings change on the row after the allocation does; costs are added."""
    n = len(close)
    out = []
    k, held, previous, changed = 1.0, np.zeros(close.shape[1]), np.full(close.shape[1], np.nan), False
    for i in range(1, n - 1):
        delta = close[i] - (open_[i] if changed else close[i - 1])
        if not out:
            held = _holdings(alloc[i], k, open_[i + 1], rate[i])
            out.append(k)
            continue
        move = np.abs(alloc[i] - previous).sum() > 0 if not np.isnan(previous).any() else True
        if changed:
            held = _holdings(alloc[i], k, open_[i + 1], rate[i])
        k += float((held * rate[i] * (delta + cost[i])).sum())
        out.append(k)
        changed = bool(move)
        previous = alloc[i]
    return np.array(out)


def _holdings(weights: np.ndarray, k: float, price: np.ndarray, rate: np.ndarray) -> np.ndarray:
    gross = np.abs(weights).sum()
    return np.nan_to_num(weights * k / (price * rate * gross)) if gross > 0 else np.zeros_like(weights)


def etf_trick(table: DataFrame) -> DataFrame:
    """(date, value) of a joined long table."""

    def run(t: pa.Table) -> pa.Table:
        wide = {c: t.to_pandas().pivot(index="date", columns="security", values=c).sort_index() for c in ("open", "close", "alloc", "cost", "rate")}
        values = etf_values(*(wide[c].to_numpy() for c in ("open", "close", "alloc", "cost", "rate")))
        dates = list(wide["close"].index[1 : 1 + len(values)])
        return pa.table({"date": pa.array(dates, pa.string()), "value": values})

    rows = table.select(F.lit(1).alias("_g"), F.col("date").cast("string").alias("date"), "security", "open", "close", "alloc", "cost", "rate")
    return rows.groupBy("_g").applyInArrow(run, "date string, value double")


def futures_roll(rows: DataFrame, method: str = "absolute", *, roll_backward: bool = False, by: str = "root") -> DataFrame:
    """(root, date, gap): what adjusts prices at contract changes, summed (absolute) or multiplied (relative), of rows
    (root, date, open, close, security, current_security)."""
    if method not in ("absolute", "relative"):
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy(by).orderBy("date")
    kept = rows.where(F.col("security") == F.col("current_security"))
    rolled = F.col("security") != F.lag("security").over(w)
    before = F.lag("close").over(w)
    plus = method == "absolute"
    gap = F.col("open") - before if plus else F.col("open") / before
    marked = kept.select(by, "date", F.when(rolled, gap).otherwise(0.0 if plus else 1.0).alias("_g"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_g").over(running) if plus else F.product("_g").over(running)
    summed = marked.select(by, "date", total.alias("gap"))
    if not roll_backward:
        return summed
    last = F.last("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return summed.withColumn("_l", last).select(by, "date", (F.col("gap") - F.col("_l") if plus else F.col("gap") / F.col("_l")).alias("gap"))
