"""Sharding by vector bin packing.

Rows with equal texts form a group, and a group stays in one shard. Each group that makes up more than a slice's share of
the bytes, tokens or rows is packed for itself; smaller groups are gathered by hash into parcels, whole as well. The number
of both is bounded by the shard count, not by the data, so the driver packs them: in order of size, each goes to
the shard where the dot product of its (bytes, tokens, rows) with the shard's residual capacity is highest. Bytes weigh four
times as much as tokens and rows, as the law is about them. Slots number the rows of a shard without gaps: each slice
of a group or parcel starts where the one before it ends, so one large group is numbered by many tasks.

Law: `bytes` (the sizes of all shards are nearly equal). Only a group that is larger than a shard's whole capacity
(1 / n_shards of the bytes, tokens or rows) is divided, into the fewest parts that fit, as the law could not hold otherwise.
A single row above that size makes its shard larger by as much. Text is read once, into a narrow table in the shared
folder; after that one shuffle sums groups and one numbers rows within slices.

Defined results: a null text has size 16 and crc32 0 as an empty one does; null doc_ids take part like any other
and come first in their slice; repeated rows get slots of their own; ties between shards go to the first; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut_lineage

ROW_BYTES = 16
DIMENSIONS = ("size", "tokens", "one")
#: Bytes count most, as the law is about them.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def pack(loads: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each parcel; loads holds a row of non-negative weights for each parcel."""
    totals = loads.sum(axis=0)
    scaled = loads / np.where(totals > 0, totals, 1.0) * n_shards
    residual = np.ones((n_shards, loads.shape[1]))
    out = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -scaled.max(axis=1, initial=0.0))):
        out[i] = int(np.argmax((residual * WEIGHTS) @ scaled[i]))
        residual[out[i]] -= scaled[i]
    return out


def parts_of(share: float, n_shards: int) -> int:
    """Into how many parts a group with this share of the whole goes: one, unless no shard can hold it."""
    return max(1, int(np.ceil(share * n_shards - 1e-9)))


def assign_shards(
    docs: DataFrame, *, n_shards: int = 40, parcels_per_shard: int = 256, slices_per_shard: int = 64
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all rows."""
    text = F.coalesce("text", F.lit(""))
    narrow = cut_lineage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("one"),
            F.xxhash64(text).alias("group"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    spark = docs.sparkSession
    sums = [F.sum(c).alias(c) for c in DIMENSIONS]
    totals = narrow.agg(*sums).first()
    names = {"size": "sizes", "tokens": "tokens", "one": "one"}
    shares = [F.col(names[c]) / float(totals[c]) for c in DIMENSIONS if totals[c]]
    group = ["group", "text_crc32", "size"]  # 64 + 32 bits and the length
    # fewer than len(DIMENSIONS) * n_shards * slices_per_shard groups can each hold more than such a share
    least = 1 / (n_shards * slices_per_shard)
    by_group = narrow.groupBy(*group).agg(*[F.sum(c).alias(names[c]) for c in DIMENSIONS])
    by_group = by_group.select(*group, F.greatest(*shares, F.lit(0.0), F.lit(0.0)).alias("share"))
    heavy = by_group.where(F.col("share") > least).orderBy(F.desc("share"), *group).collect()
    n_parcels = n_shards * parcels_per_shard
    slices, rows = n_parcels, []
    unit_of = list(range(n_parcels))  # what is packed as one, of each slice
    for g in heavy:
        parts = parts_of(g["share"], n_shards)
        n = max(parts, int(np.ceil(g["share"] / least)))
        rows.append((g["group"], g["text_crc32"], g["size"], slices, n))
        unit_of += [unit_of[-1] + 1 + k * parts // n for k in range(n)]
        slices += n
    dealt = spark.createDataFrame(rows, "group long, text_crc32 long, size long, first long, n long")
    sliced = narrow.join(F.broadcast(dealt), group, "left").withColumn(
        "slice",
        F.when(F.col("n").isNull(), F.pmod(F.xxhash64("group"), F.lit(n_parcels))).otherwise(
            F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))
        ),
    )
    summed = sliced.groupBy("slice").agg(*sums).orderBy("slice").collect()
    loads = np.zeros((unit_of[-1] + 1, len(DIMENSIONS)))
    for p in summed:
        loads[unit_of[p["slice"]]] += [p[c] for c in DIMENSIONS]
    shards = pack(loads, n_shards)
    filled = np.zeros(n_shards, dtype=np.int64)
    places = []
    for p in summed:
        shard = int(shards[unit_of[p["slice"]]])
        places.append((p["slice"], shard, int(filled[shard])))
        filled[shard] += p["one"]
    placed = spark.createDataFrame(places, "slice long, shard int, first_slot long")
    order = Window.partitionBy("slice").orderBy("doc_id", "row")
    return (
        sliced.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(placed), "slice")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
