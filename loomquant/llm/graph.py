"""Connected components by alternating large-star and small-star steps; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    """Tells two states of the edges apart."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b), orderable columns without nulls; the component is its least
    node. Rounds grow with the logarithm of the components' size."""
    state = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    before = _mark(state)
    while before[0]:
        state = stored(_small_star(_large_star(state)).where(F.col("a") != F.col("b")).distinct())
        after = _mark(state)
        if after == before:
            break
        before = after
    labels = state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionAll(roots)
