"""Market-data views over the test tables, which hold no prices themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, ord, price, volume, user_id)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("ord"),
        F.col("value").alias("price"),
        (F.col("user_id") % 10 + 1).cast("double").alias("volume"),
        "user_id",
    )


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders by priority."""
    bars = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"))
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return bars.agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by (ts, asset)."""
    by = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("asset"))
    return by.agg(F.avg("o_totalprice").alias("price"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label spans (symbol, id, start, end, side, prob) over ticks."""
    hours = F.make_dt_interval(F.lit(0), (1 + F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("start"),
        (F.col("ts") + hours).alias("end"),
        F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("side"),
        (0.5 + (F.col("user_id") % 50) / 101.0).alias("prob"),
    )
