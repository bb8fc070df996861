"""Ensembles, feature importance and model fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validation import LinearProbability, Splits, score

# Predictions as rows (sample, model, value)


def bias_variance_noise(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: squared bias, variance, mean squared error and what is left as noise (at least 0)."""
    p = predictions.join(truth, "sample")
    by = p.groupBy("sample").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.avg(F.pow(F.col("value") - F.col("y"), 2)).alias("e"), F.first("y").alias("y"))
    s = by.agg(F.avg(F.pow(F.col("m") - F.col("y"), 2)).alias("bias_sq"), F.avg("v").alias("variance"), F.avg("e").alias("mse"))
    return s.withColumn("noise", F.greatest(F.lit(0.0), F.col("mse") - F.col("bias_sq") - F.col("variance")))


def regression_mean(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("sample").agg(F.avg("value").alias("value"))


def classification_vote(predictions: DataFrame) -> DataFrame:
    """Majority of 0/1 votes, 1 on ties; other labels fail."""
    bad = F.raise_error(F.lit("votes are 0 or 1")).cast("int")
    v = F.when(F.col("value").isin(0, 1), F.col("value").cast("int")).otherwise(bad)
    return predictions.groupBy("sample").agg((2 * F.sum(v) >= F.count("*")).cast("int").alias("label"))


def probability_mean(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    m = predictions.groupBy("sample").agg(F.avg("value").alias("probability"))
    return m.withColumn("label", (F.col("probability") >= threshold).cast("int"))


def average_pairwise_correlation(predictions: DataFrame) -> DataFrame:
    """One row: mean correlation of all pairs of models, 0 where one is constant. Models are few; samples are joined by
    key."""
    a = predictions.select("sample", F.col("model").alias("ma"), F.col("value").alias("va"))
    b = predictions.select("sample", F.col("model").alias("mb"), F.col("value").alias("vb"))
    pairs = a.join(b, "sample").where(F.col("ma") < F.col("mb")).groupBy("ma", "mb").agg(F.corr("va", "vb").alias("r"))
    return pairs.agg(F.avg(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("correlation"))


def bootstrap_indices(spark, n: int, size: int, seed: int) -> DataFrame:
    """(draw, idx) with replacement; a draw depends on the seed and its number only."""
    return spark.range(size).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("idx"))


def bagging_regression(bags: DataFrame, rows: DataFrame) -> DataFrame:
    """(sample, value): mean over estimators of univariate regressions, each fitted on its bag (estimator, x, y)."""
    fits = bags.groupBy("estimator").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("m"))
    sums = fits.agg(F.avg(F.coalesce("b", F.lit(0.0))).alias("b"), F.avg(F.coalesce("a", "m")).alias("a"))
    return rows.crossJoin(F.broadcast(sums)).select("sample", (F.col("a") + F.col("b") * F.col("x")).alias("value"))


def bagging_stumps(bags: DataFrame, rows: DataFrame) -> DataFrame:
    """(sample, label): majority of stumps at the mean of their bag's feature; the side above the mean takes the majority
    label of its rows. The stumps, as many as estimators, go to every row as one array."""
    cut = bags.groupBy("estimator").agg(F.avg("x").alias("cut"))
    sides = bags.join(cut, "estimator").groupBy("estimator", "cut").agg(
        F.avg(F.when(F.col("x") > F.col("cut"), F.col("y"))).alias("up"), F.avg(F.when(F.col("x") <= F.col("cut"), F.col("y"))).alias("down"), F.avg("y").alias("all")
    )
    up, down = ((F.coalesce(c, "all") >= 0.5).cast("int").alias(c) for c in ("up", "down"))
    stumps = sides.agg(F.collect_list(F.struct("cut", up, down)).alias("stumps"))
    votes = F.aggregate("stumps", F.lit(0), lambda n, s: n + F.when(F.col("x") > s["cut"], s["up"]).otherwise(s["down"]))
    return rows.crossJoin(F.broadcast(stumps)).select("sample", (2 * votes >= F.size("stumps")).cast("int").alias("label"))


# Importance


def mean_decrease_impurity(trees: DataFrame) -> DataFrame:
    """(feature, mean, std_error) of rows (tree, feature, importance): zeros are left out, means sum to 1."""
    v = F.when(F.col("importance") != 0, F.col("importance"))
    s = trees.groupBy("feature").agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_pop(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias("e"))
    t = s.agg(F.sum("m").alias("t"))
    return s.crossJoin(F.broadcast(t)).select("feature", (F.col("m") / F.col("t")).alias("mean"), (F.col("e") / F.col("t")).alias("std_error"))


def _summary(values: list[list[float]], names: list[str]) -> pd.DataFrame:
    a = np.array(values)
    return pd.DataFrame({"feature": names, "mean": a.mean(axis=0), "std_error": a.std(axis=0) / np.sqrt(len(a))})


def mean_decrease_accuracy(model, x: np.ndarray, y: np.ndarray, names: list[str], splits: Splits, scoring: str = "neg_log_loss", shift: int = 1) -> pd.DataFrame:
    """Relative loss of score when a column is rotated within the test rows."""
    rows = []
    for train, test in splits:
        model.fit(x[train], y[train])
        base = score(y[test], model.predict_proba(x[test]), scoring)
        out = []
        for j in range(x.shape[1]):
            rotated = x[test].copy()
            rotated[:, j] = np.roll(rotated[:, j], shift)
            s = score(y[test], model.predict_proba(rotated), scoring)
            gain = base - s
            scale = -s if scoring == "neg_log_loss" else 1 - s
            out.append(gain / scale if scale else 0.0)
        rows.append(out)
    return _summary(rows, names)


def single_feature_importance(model, x: np.ndarray, y: np.ndarray, names: list[str], splits: Splits, scoring: str = "neg_log_loss") -> pd.DataFrame:
    """Score of each feature alone."""
    rows = []
    for train, test in splits:
        rows.append([score(y[test], model.fit(x[train][:, [j]], y[train]).predict_proba(x[test][:, [j]]), scoring) for j in range(x.shape[1])])
    return _summary(rows, names)


def bootstrap_mdi(x: np.ndarray, y: np.ndarray, names: list[str], estimators: int = 32, seed: int = 0) -> pd.DataFrame:
    """Shares of absolute standardised coefficients over bootstrapped linear probability models."""
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-12)
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(estimators):
        at = rng.integers(len(z), size=len(z))
        c = np.abs(LinearProbability().fit(z[at], y[at]).coef[1:])
        rows.append((c / c.sum() if c.sum() > 0 else c).tolist())
    return _summary(rows, names)


def gram(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Means, deviations (ddof 0), correlation matrix and number of rows by one aggregate."""
    k = len(features)
    sums = [F.count("*")] + [F.avg(c) for c in features] + [F.stddev_pop(c) for c in features]
    sums += [F.corr(features[i], features[j]) for i in range(k) for j in range(i + 1, k)]
    row = list(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    corr = np.eye(k)
    for v, (i, j) in zip(row[1 + 2 * k :], [(i, j) for i in range(k) for j in range(i + 1, k)], strict=True):
        corr[i, j] = corr[j, i] = 0.0 if v is None or v != v else v
    return np.array(row[1 : 1 + k], dtype=float), np.array(row[1 + k : 1 + 2 * k], dtype=float), corr, row[0]


def orthogonal_features(df: DataFrame, features: list[str], threshold: float = 0.95, *, keep: list[str] = ()) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """`keep` columns with components pc_0, pc_1, ... up to the share of variance; eigenvalues and vectors. Rows are
    projected by column expressions."""
    mean, sd, corr, _ = gram(df, features)
    value, vector = np.linalg.eigh(corr)
    order = np.argsort(-value)
    value, vector = value[order], vector[:, order]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), range(len(value))] < 0, -1, 1)  # a fixed sign
    k = int(np.searchsorted(np.cumsum(value) / value.sum(), threshold - 1e-12) + 1)
    columns = []
    for c in range(k):
        terms = [(F.col(f) - float(mean[i])) / float(sd[i] or 1.0) * float(vector[i, c]) for i, f in enumerate(features)]
        columns.append(sum(terms[1:], terms[0]).alias(f"pc_{c}"))
    return df.select(*keep, *columns), value[:k], vector[:, :k]


def kendall(x: np.ndarray, y: np.ndarray, weighted: bool = False) -> float:
    """Concordance of pairs; ties count 0. Weighted: pairs of early ranks count more."""
    i, j = np.triu_indices(len(x), 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    w = 1 / (1 + i + j) if weighted else np.ones(len(s))
    both = (w * (s != 0)).sum()
    return float((w * s).sum() / both) if both > 0 else 0.0


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of ordinal ranks."""
    a, b = (np.argsort(np.argsort(v, kind="stable"), kind="stable").astype(float) for v in (x, y))
    return float(np.corrcoef(a, b)[0, 1])


def pca_agreement(importance: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> dict[str, float]:
    """How an importance ranking agrees with the weight of the features in the components."""
    strength = np.abs(vectors * values).sum(axis=1)
    return {
        "pearson": float(np.corrcoef(importance, strength)[0, 1]),
        "spearman": spearman(importance, strength),
        "kendall": kendall(importance, strength),
        "weighted_kendall": kendall(importance, strength, True),
    }


def substitution_report(model, x: np.ndarray, y: np.ndarray, names: list[str], splits: Splits, corr_threshold: float = 0.9, scoring: str = "neg_log_loss", flag: float = 1.15) -> pd.DataFrame:
    """Pairs of correlated features: loss of score when both are rotated against the sum of single losses."""
    corr = np.corrcoef(x.T)
    pairs = [(i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1]) if abs(corr[i, j]) >= corr_threshold]
    rows = []
    for i, j in pairs:
        single = joint = 0.0
        for train, test in splits:
            model.fit(x[train], y[train])
            base = score(y[test], model.predict_proba(x[test]), scoring)
            losses = []
            for cols in ([i], [j], [i, j]):
                r = x[test].copy()
                r[:, cols] = np.roll(r[:, cols], 1, axis=0)
                losses.append(base - score(y[test], model.predict_proba(r), scoring))
            single, joint = single + losses[0] + losses[1], joint + losses[2]
        ratio = joint / single if single > 0 else 0.0
        rows.append((names[i], names[j], float(corr[i, j]), single / len(splits), joint / len(splits), ratio, ratio > flag))
    return pd.DataFrame(rows, columns=["left", "right", "correlation", "single", "joint", "ratio", "substitutes"])


def feature_screen(df: DataFrame, features: list[str], *, min_coverage: float = 0.95, min_std: float = 1e-9, max_correlation: float = 0.95) -> pd.DataFrame:
    """(feature, coverage, std, correlated_with, accepted, reason): coverage and deviation by one aggregate, correlations
    over rows that have both, then features are taken in order unless they follow an accepted one too closely."""
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    sums = [F.count("*")] + [F.count(c) for c in features] + [F.stddev_samp(c) for c in features]
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    both = {(i, j): F.col(features[i]).isNotNull() & F.col(features[j]).isNotNull() for i, j in pairs}
    sums += [F.corr(F.when(both[p], F.col(features[p[0]])), F.when(both[p], F.col(features[p[1]]))) for p in pairs]
    row = list(clean.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    n, count, std = row[0], row[1 : 1 + k], row[1 + k : 1 + 2 * k]
    corr = dict(zip(pairs, row[1 + 2 * k :], strict=True))
    rows, taken = [], []
    for j, f in enumerate(features):
        coverage, sd = (count[j] / n if n else 0.0), std[j] or 0.0
        near = next((i for i in taken if abs(corr[i, j] or 0.0) >= max_correlation), None)
        reason = "coverage" if coverage < min_coverage else "constant" if sd <= min_std else "correlated" if near is not None else ""
        if not reason:
            taken.append(j)
        rows.append((f, coverage, sd, features[near] if near is not None and reason == "correlated" else None, not reason, reason))
    return pd.DataFrame(rows, columns=["feature", "coverage", "std", "correlated_with", "accepted", "reason"])


# Fingerprints


def feature_grid(df: DataFrame, features: list[str], points: int) -> dict[str, list[float]]:
    """Evenly spaced quantiles of each feature, interpolated."""
    qs = [i / max(points - 1, 1) for i in range(points)]
    row = df.agg(*[F.percentile(c, qs).alias(c) for c in features]).first()
    return {c: [float(v) for v in row[c]] for c in features}


def partial_dependence(df: DataFrame, features: list[str], predict, grid: dict[str, list[float]]) -> DataFrame:
    """(feature, value, mean): mean prediction with one feature set to each grid value. Each batch is predicted once for
    each grid point and summed where it is; one row for each grid point leaves a task."""
    keys = [(f, v) for f in features for v in grid[f]]

    def run(batches):
        total, n = np.zeros(len(keys)), 0
        for rows in batches:
            x = rows[features].to_numpy(dtype=float)
            n += len(x)
            for k, (f, v) in enumerate(keys):
                held = x.copy()
                held[:, features.index(f)] = v
                total[k] += float(np.sum(predict(held)))
        yield pd.DataFrame({"feature": [k[0] for k in keys], "value": [k[1] for k in keys], "total": total, "n": [n] * len(keys)})

    parts = df.select(*features).mapInPandas(run, "feature string, value double, total double, n long")
    return parts.groupBy("feature", "value").agg((F.sum("total") / F.sum("n")).alias("mean"))


def fingerprint(pd_rows: DataFrame) -> DataFrame:
    """(feature, linear, non_linear, linear_share, non_linear_share): mean absolute departure of the fitted line from the
    mean, and of the dependence from its line; shares sum to 1 over the features."""
    fit = pd_rows.groupBy("feature").agg(F.regr_slope("mean", "value").alias("b"), F.regr_intercept("mean", "value").alias("a"), F.avg("mean").alias("m"))
    line = F.coalesce(F.col("a") + F.col("b") * F.col("value"), F.col("m"))
    effects = pd_rows.join(fit, "feature").groupBy("feature").agg(F.avg(F.abs(line - F.col("m"))).alias("linear"), F.avg(F.abs(F.col("mean") - line)).alias("non_linear"))
    totals = effects.agg(F.sum("linear").alias("tl"), F.sum("non_linear").alias("tn"))
    shares = [F.coalesce(F.try_divide(F.col(c), F.col(t)), F.lit(0.0)).alias(f"{c}_share") for c, t in (("linear", "tl"), ("non_linear", "tn"))]
    return effects.crossJoin(F.broadcast(totals)).select("feature", "linear", "non_linear", *shares)


def pairwise_effect(df: DataFrame, features: list[str], predict, pair: tuple[str, str], grid: dict[str, list[float]]) -> float:
    """Mean absolute interaction of two features: joint dependence less its mean and both centred single ones."""
    a, b = pair
    keys = [(u, v) for u in grid[a] for v in grid[b]]

    def run(batches):
        total, n = np.zeros(len(keys)), 0
        for rows in batches:
            x = rows[features].to_numpy(dtype=float)
            n += len(x)
            for k, (u, v) in enumerate(keys):
                held = x.copy()
                held[:, features.index(a)], held[:, features.index(b)] = u, v
                total[k] += float(np.sum(predict(held)))
        yield pd.DataFrame({"k": range(len(keys)), "total": total, "n": [n] * len(keys)})

    got = df.select(*features).mapInPandas(run, "k int, total double, n long").groupBy("k").agg((F.sum("total") / F.sum("n")).alias("m"))
    joint = np.zeros(len(keys))
    for r in got.collect():
        joint[r["k"]] = r["m"]
    joint = joint.reshape(len(grid[a]), len(grid[b]))
    centred = joint - joint.mean()
    return float(np.abs(centred - centred.mean(axis=1, keepdims=True) - centred.mean(axis=0, keepdims=True)).mean())
