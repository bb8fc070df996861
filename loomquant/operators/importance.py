"""Importance of features for a linear probability model, over any number of rows.

One aggregate gives the normal equations of every fold; the model that leaves a fold out is solved on the driver from the
sum of the others (a matrix over the features). Scores are a second aggregate, in which the coefficients are literals. Rows
carry their fold, so whatever purging they need is done before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FOLDS = 1_000
RIDGE = 1e-3


def fold_grams(df: DataFrame, features: list[str], y: str, fold: str) -> dict[int, np.ndarray]:
    """Gram matrix of (1, features, y) by fold; folds are few."""
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in [*features, y])]
    k = len(columns)
    sums = [F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = df.groupBy(fold).agg(*sums).limit(MAX_FOLDS + 1).collect()
    if not 1 < len(rows) <= MAX_FOLDS:
        raise ValueError(f"from 2 to {MAX_FOLDS} folds are needed, not {len(rows)}")
    out = {}
    for r in rows:
        g = np.zeros((k, k))
        g[np.triu_indices(k)] = [float(v or 0) for v in r[1:]]
        out[r[0]] = g + np.triu(g, 1).T
    return out


def left_out(grams: dict[int, np.ndarray], which: list[int], ridge: float = RIDGE) -> dict[int, list[float]]:
    """Coefficients (intercept first) of each fold's model, fitted on all other folds by the features `which`."""
    total = sum(grams.values())
    at = [0, *(i + 1 for i in which)]
    out = {}
    for f, g in grams.items():
        rest = total - g
        out[f] = np.linalg.solve(rest[np.ix_(at, at)] + ridge * np.eye(len(at)), rest[at, -1]).tolist()
    return out


def _probability(coef: dict[int, list[float]], values: list[Column], fold: str) -> Column:
    """Prediction of a row by the model of its fold, cut to probabilities."""
    table = F.create_map(*[x for f, c in coef.items() for x in (F.lit(f), F.array(*map(F.lit, c)))])
    own = F.try_element_at(table, F.col(fold))
    raw = F.get(own, F.lit(0))
    for k, v in enumerate(values):
        raw = raw + F.get(own, F.lit(k + 1)) * v
    return F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), raw))


def _score(p: Column, y: Column, scoring: str) -> Column:
    if scoring == "accuracy":
        return F.avg(((p >= 0.5).cast("double") == y).cast("double"))
    if scoring == "neg_log_loss":
        return F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    raise ValueError(f"unknown scoring {scoring!r}")


def _summary(by_fold: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std_error) from one column for each feature and one row for each fold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("x")
    rows = by_fold.select(pairs).select("x.*")
    return rows.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("std_error"))


def single_feature_scores(df: DataFrame, features: list[str], y: str, fold: str, *, scoring: str = "neg_log_loss") -> DataFrame:
    """(feature, mean, std_error): score of each feature alone, over folds."""
    grams = fold_grams(df, features, y, fold)
    target = F.col(y).cast("double")
    scores = [_score(_probability(left_out(grams, [i]), [F.col(c).cast("double")], fold), target, scoring).alias(c) for i, c in enumerate(features)]
    return _summary(df.groupBy(fold).agg(*scores), features)


def decrease_in_accuracy(df: DataFrame, features: list[str], y: str, fold: str, *, key: str, block: int = 4096, scoring: str = "neg_log_loss") -> DataFrame:
    """(feature, mean, std_error): relative loss of score, over folds, when a feature is rotated by one row among the rows of
    its fold. Rows rotate in order of the integer `key` within blocks of `block` keys, so no fold is sorted in one task."""
    grams = fold_grams(df, features, y, fold)
    coef = left_out(grams, list(range(len(features))))
    w = Window.partitionBy(fold, F.floor(F.col(key) / block)).orderBy(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = [F.coalesce(F.lag(c).over(w), F.last(c).over(whole)).cast("double").alias(f"_{c}") for c in features]
    rows = df.select(fold, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features], *turned)
    own = [F.col(c) for c in features]
    scores = [_score(_probability(coef, own, fold), F.col("_y"), scoring).alias("_base")]
    for i, c in enumerate(features):
        scores.append(_score(_probability(coef, [*own[:i], F.col(f"_{c}"), *own[i + 1 :]], fold), F.col("_y"), scoring).alias(c))
    by_fold = rows.groupBy(fold).agg(*scores)
    room = (lambda s: -s) if scoring == "neg_log_loss" else (lambda s: 1 - s)
    lost = [F.coalesce(F.try_divide(F.col("_base") - F.col(c), room(F.col(c))), F.lit(0.0)).alias(c) for c in features]
    return _summary(by_fold.select(*lost), features)
