"""Tick files: date and time, price, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The formats in which the first column may be written.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def load_ticks(spark: SparkSession, path: str, *, symbol: str = "all") -> DataFrame:
    """(symbol, ts, ord, price, volume) of a CSV file or folder with a header and three columns, whatever they are called.
    A value that is no time or no number is an error when it is read; `ord` is the order of reading."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    if len(raw.columns) != 3:
        raise ValueError(f"a tick file has date and time, price and volume, not {raw.columns}")
    stamp, price, volume = (F.col(f"`{c}`") for c in raw.columns)

    def wanted(value, text, what: str):
        wrong = F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(text, F.lit("nothing"))))
        return F.coalesce(value, wrong.cast(value_types[what]))

    value_types = {"time": "timestamp_ntz", "price": "double", "volume": "double"}
    times = [F.try_to_timestamp(stamp, F.lit(f)).cast("timestamp_ntz") for f in FORMATS]
    return raw.select(
        F.lit(symbol).alias("symbol"),
        wanted(F.coalesce(*times), stamp, "time").alias("ts"),
        F.monotonically_increasing_id().alias("ord"),
        wanted(price.try_cast("double"), price, "price").alias("price"),
        wanted(volume.try_cast("double"), volume, "volume").alias("volume"),
    )
