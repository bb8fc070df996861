"""Bagging over sequentially bootstrapped spans, with out-of-bag scores, sample weights and feature subsets.

Rows are (id, x array<double>, y, weight) and spans (id, start, end) in integer bars. Each estimator takes one feature of
its subset and a bag of draws; all estimators are fitted by one aggregate, and predictions take them as one bounded array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weights import sequential_bootstrap

KINDS = ("classifier", "regressor")


def resolve_share(value: int | float, n: int, what: str) -> int:
    """A count, or a share of n as a count; it has to be from 1 to n."""
    count = value if isinstance(value, int) else int(value * n)
    if not 1 <= count <= n:
        raise ValueError(f"{what} must be from 1 to {n}, not {value}")
    return count


def feature_subsets(n_features: int, estimators: int, max_features: int | float = 1.0, *, replace: bool = False, seed: int = 0) -> list[list[int]]:
    """Features of each estimator, drawn with or without replacement; numbers depend on seed and estimator only."""
    k = resolve_share(max_features, n_features, "max_features")
    return [np.random.default_rng([seed, e]).choice(n_features, k, replace=replace).tolist() for e in range(estimators)]


def draw_bags(spans: DataFrame, estimators: int, size: int, *, seed: int = 0) -> DataFrame:
    """(estimator, id): `size` sequential draws for each estimator, without a warm-up, so that draws follow uniqueness."""
    drawn = sequential_bootstrap(spans.withColumn("symbol", F.lit("all")), replicates=estimators, size=size, seed=seed)
    return drawn.select(F.col("replicate").alias("estimator"), "id")


def _bagged(bags: DataFrame, rows: DataFrame, features: list[int]) -> DataFrame:
    """(estimator, feature, x, y, weight) of the drawn rows."""
    of = F.get(F.array(*map(F.lit, features)), F.col("estimator"))
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    joined = bags.join(rows.select("id", F.col("x").alias("_x"), "y", weight.cast("double").alias("weight")), "id")
    return joined.withColumn("feature", of).select("estimator", "feature", F.get("_x", F.col("feature")).alias("x"), "y", "weight")


def fit_stumps(bags: DataFrame, rows: DataFrame, features: list[int]) -> DataFrame:
    """(estimator, feature, cut, above): a stump at the weighted mean of its feature; it votes 1 on the side, at or above
    the cut or below it, where 1 is more frequent (above on ties; an empty side counts as 0)."""
    b = _bagged(bags, rows, features)
    cuts = b.groupBy("estimator").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("cut"))
    high = F.col("x") >= F.col("cut")

    def rate(side: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(side, F.col("weight") * F.col("y"))), F.sum(F.when(side, F.col("weight")))), F.lit(0.0))

    sides = b.join(F.broadcast(cuts), "estimator").groupBy("estimator", "feature", "cut")
    return sides.agg((rate(high) >= rate(~high)).alias("above"))


def fit_lines(bags: DataFrame, rows: DataFrame, features: list[int]) -> DataFrame:
    """(estimator, feature, slope, intercept) of weighted least squares; a constant feature has slope 0."""
    w, x, y = F.col("weight"), F.col("x"), F.col("y")
    s = _bagged(bags, rows, features).groupBy("estimator", "feature")
    s = s.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    slope = F.coalesce(F.try_divide(F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w"), F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")), F.lit(0.0))
    return s.select("estimator", "feature", slope.alias("slope"), ((F.col("wy") - slope * F.col("wx")) / F.col("w")).alias("intercept"))


def _one(model: Column, x: Column, kind: str) -> Column:
    """What one estimator says about a row."""
    value = F.get(x, model["feature"])
    if kind == "regressor":
        return model["intercept"] + model["slope"] * value
    return (F.when(value >= model["cut"], model["above"]).otherwise(~model["above"])).cast("double")


def _joined(said: Column, n: Column, kind: str) -> Column:
    """Majority, 1 on ties, or the mean."""
    return said / n if kind == "regressor" else (2 * said >= n).cast("double")


def predict(models: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """(id, value): majority vote or mean over all estimators."""
    packed = models.agg(F.collect_list(F.struct(*models.columns)).alias("_m"))
    said = F.aggregate("_m", F.lit(0.0), lambda s, m: s + _one(m, F.col("x"), kind))
    return rows.crossJoin(F.broadcast(packed)).select("id", _joined(said, F.size("_m"), kind).alias("value"))


def out_of_bag(models: DataFrame, bags: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """(id, y, value, n): the same over the n estimators whose bag misses the row; rows in every bag are left out."""
    packed = models.agg(F.collect_list(F.struct(*models.columns)).alias("_m"))
    held = bags.groupBy("id").agg(F.collect_set("estimator").alias("_in"))
    seen = rows.join(held, "id", "left").crossJoin(F.broadcast(packed))
    free = F.filter("_m", lambda m: ~F.coalesce(F.array_contains("_in", m["estimator"]), F.lit(False)))
    out = seen.select("id", "x", "y", free.alias("_f")).where(F.size("_f") > 0)
    said = F.aggregate("_f", F.lit(0.0), lambda s, m: s + _one(m, F.col("x"), kind))
    return out.select("id", F.col("y").cast("double").alias("y"), _joined(said, F.size("_f"), kind).alias("value"), F.size("_f").alias("n"))


def oob_score(found: DataFrame, kind: str) -> DataFrame:
    """One row: rows and accuracy, or rows and coefficient of determination."""
    if kind == "classifier":
        return found.agg(F.count("*").alias("rows"), F.avg((F.col("value") == F.col("y")).cast("double")).alias("score"))
    mean = found.agg(F.avg("y").alias("_mean"))
    spread = F.try_divide(F.sum(F.pow(F.col("y") - F.col("value"), 2)), F.sum(F.pow(F.col("y") - F.col("_mean"), 2)))
    return found.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("rows"), (1 - spread).alias("score"))


@dataclass
class SequentialBagging:
    """An ensemble whose bags are sequential bootstraps. `fit` returns it with models and bags; a warm start adds
    estimators to those that it has and cannot be scored out of bag."""

    kind: str = "classifier"
    estimators: int = 10
    max_samples: int | float = 1.0
    max_features: int | float = 1.0
    bootstrap_features: bool = False
    warm_start: bool = False
    seed: int = 0
    models: DataFrame | None = None
    bags: DataFrame | None = None
    fitted: int = 0

    def fit(self, rows: DataFrame, spans: DataFrame) -> SequentialBagging:
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        if self.estimators < 1:
            raise ValueError("at least one estimator is needed")
        before = self.fitted if self.warm_start else 0
        if self.estimators < before:
            raise ValueError(f"a warm start cannot go back from {before} to {self.estimators} estimators")
        if self.estimators == before:
            return self
        n, n_features = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit")
        size = resolve_share(self.max_samples, n, "max_samples")
        subsets = feature_subsets(n_features, self.estimators, self.max_features, replace=self.bootstrap_features, seed=self.seed)
        features = [s[0] for s in subsets]
        bags = draw_bags(spans, self.estimators, size, seed=self.seed).where(F.col("estimator") >= before)
        models = (fit_stumps if self.kind == "classifier" else fit_lines)(bags, rows, features)
        kept = before > 0
        self.bags = self.bags.unionByName(bags) if kept else bags
        self.models = self.models.unionByName(models) if kept else models
        self.fitted = self.estimators
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.models is None:
            raise ValueError("fit comes first")
        return predict(self.models, rows, self.kind)

    def oob(self, rows: DataFrame) -> DataFrame:
        if self.models is None or self.warm_start:
            raise ValueError("a score out of bag needs one fit without a warm start")
        return oob_score(out_of_bag(self.models, self.bags, rows, self.kind), self.kind)
