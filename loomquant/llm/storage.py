"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A session on one machine that names none gets one of its own; on a cluster
    that is an error, as executors do not see each other's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="loomquant-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there, so that lost executors cost no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Settings of Arrow batches with the values that Spark starts with, and ours: batches of whole texts stay small.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of documents holds, unless the session has its own choice."""
    for name, (initial, ours) in _BATCHES.items():
        if spark.conf.get(name, None) == initial:
            spark.conf.set(name, ours)


def stored(frame: DataFrame) -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them back: like `cut_lineage`, but compressed
    and columnar, for tables that are read more than once."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
