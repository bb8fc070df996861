"""Purged validation splits, walk-forward and combinatorial backtests, model scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def train_times(spans: DataFrame, tests: DataFrame) -> DataFrame:
    """Training spans (start, end) that neither start in, end in, nor envelop a test span. A span overlaps a test span if
    some test span that starts by its end reaches to its start, and the tests by a time reach as far as their greatest end
    so far: one running maximum over both sides in order of time, and no span meets a test span. The axis (timestamps) is cut
    into days; what reaches into a day from before it is a running maximum over the days, which are few and broadcast."""
    day = F.date_trunc("day", F.col("_t"))
    sides = tests.where(F.col("start") <= F.col("end")).select(F.col("start").alias("_t"), F.lit(0).alias("_k"), F.col("end").alias("_reach"))
    row = F.struct(*spans.columns)
    marks = spans.select(F.col("end").alias("_t"), F.lit(1).alias("_k"), row.alias("_row"))
    sides = sides.withColumn("_row", F.lit(None).cast(marks.schema["_row"].dataType))
    both = sides.unionByName(marks, allowMissingColumns=True).withColumn("_day", day)
    reach = both.where("_k = 0").groupBy("_day").agg(F.max("_reach").alias("_reach"))
    before = F.max("_reach").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = both.select("_day").distinct().join(reach, "_day", "left").select("_day", before.alias("_before"))
    run = F.max("_reach").over(Window.partitionBy("_day").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_run", run).where("_k = 1").join(F.broadcast(days), "_day")
    far = F.greatest("_run", "_before")
    return inside.where(far.isNull() | (far < F.col("_row.start"))).select("_row.*")


def fold_of(n: int, folds: int) -> np.ndarray:
    """Contiguous folds; the first n % folds hold one row more."""
    if not 1 < folds <= n:
        raise ValueError("need at least two folds and a row for each")
    sizes = np.full(folds, n // folds)
    sizes[: n % folds] += 1
    return np.repeat(np.arange(folds), sizes)


def purge(starts: np.ndarray, ends: np.ndarray, test: np.ndarray, embargo: int) -> np.ndarray:
    """Mask of rows to train on: outside the test rows, their embargo on both sides and every span that overlaps a test
    span. Sorting the test spans by start makes the overlap a prefix maximum."""
    n = len(starts)
    keep = ~test
    at = np.flatnonzero(test)
    order = at[np.argsort(starts[at], kind="stable")]
    reach = np.maximum.accumulate(ends[order])
    before = np.searchsorted(starts[order], ends, "right")  # test spans that start by a row's end
    overlap = (before > 0) & (np.where(before > 0, reach[np.maximum(before - 1, 0)], starts) >= starts)
    keep &= ~((before > 0) & overlap)
    if embargo:
        edge = np.zeros(n + 1, dtype=int)
        np.add.at(edge, np.maximum(at - embargo, 0), 1)
        np.add.at(edge, np.minimum(at + embargo, n - 1) + 1, -1)
        keep &= np.cumsum(edge)[:n] == 0
    return keep


Splits = list[tuple[np.ndarray, np.ndarray]]


def purged_kfold(starts: np.ndarray, ends: np.ndarray, folds: int, pct_embargo: float = 0.0) -> Splits:
    fold = fold_of(len(starts), folds)
    embargo = math.ceil(pct_embargo * len(starts))
    return [(np.flatnonzero(purge(starts, ends, fold == k, embargo)), np.flatnonzero(fold == k)) for k in range(folds)]


def walk_forward(starts: np.ndarray, ends: np.ndarray, min_train: int, test_size: int, step: int, pct_embargo: float = 0.0) -> Splits:
    """Growing training sets before test windows that step ahead; the last window may be shorter."""
    if min_train < 1 or test_size < 1 or step < 1:
        raise ValueError("training size, test size and step are at least 1")
    n, out = len(starts), []
    embargo = math.ceil(pct_embargo * n)
    for begin in range(min_train, n, step):
        test = np.zeros(n, dtype=bool)
        test[begin : begin + test_size] = True
        keep = purge(starts, ends, test, embargo)
        keep[begin:] = False
        if not keep.any():
            raise ValueError(f"purging leaves nothing to train on before row {begin}")
        out.append((np.flatnonzero(keep), np.flatnonzero(test)))
    return out


def cpcv_path_count(groups: int, test_groups: int) -> int:
    return math.comb(groups, test_groups) * test_groups // groups


def cpcv(starts: np.ndarray, ends: np.ndarray, groups: int, test_groups: int, pct_embargo: float = 0.0) -> tuple[Splits, list[tuple[int, ...]], list[dict[int, int]]]:
    """Splits for all combinations of test groups, the groups of each split, and the paths: path j takes each group from
    the j-th split that tests it."""
    fold = fold_of(len(starts), groups)
    embargo = math.ceil(pct_embargo * len(starts))
    chosen = list(combinations(range(groups), test_groups))
    splits = []
    for c in chosen:
        test = np.isin(fold, c)
        splits.append((np.flatnonzero(purge(starts, ends, test, embargo)), np.flatnonzero(test)))
    seen: dict[int, list[int]] = {g: [s for s, c in enumerate(chosen) if g in c] for g in range(groups)}
    paths = [{g: seen[g][j] for g in range(groups)} for j in range(cpcv_path_count(groups, test_groups))]
    return splits, chosen, paths


def summarize(split_returns: DataFrame) -> DataFrame:
    """(split, n, mean, std, sharpe): sharpe is mean / std * sqrt(n)."""
    s = split_returns.groupBy("split").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std"))
    return s.withColumn("sharpe", F.coalesce(F.try_divide("mean", F.col("std")) * F.sqrt("n"), F.lit(0.0)))


def run_splits(spark: SparkSession, splits: Splits, evaluate: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(split, idx, ret): the evaluator gets train and test rows and returns a return for each test row; each split is a
    task of its own."""
    rows = [(i, tr.tolist(), te.tolist()) for i, (tr, te) in enumerate(splits)]
    table = spark.createDataFrame(rows, "split int, train array<long>, test array<long>").repartition(max(1, len(rows)), "split")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                got = np.asarray(evaluate(np.array(r["train"], dtype=int), np.array(r["test"], dtype=int)), dtype=float)
                if not np.isfinite(got).all():
                    raise ValueError("the evaluator returned a value that is not finite")
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([r["split"]] * n, pa.int32()), pa.array(r["test"]), pa.array(got)], ["split", "idx", "ret"])

    return table.mapInArrow(run, "split int, idx long, ret double")


Evaluator = Callable[[np.ndarray, np.ndarray], np.ndarray]


def run_walk_forward(spark: SparkSession, starts: np.ndarray, ends: np.ndarray, evaluate: Evaluator, notes: dict[str, str], *, min_train: int, test_size: int, step: int, pct_embargo: float = 0.0) -> DataFrame:
    """(split, n, mean, std, sharpe, trained) of each window of a walk-forward backtest."""
    check_safeguards(notes)
    return _with_sizes(spark, walk_forward(starts, ends, min_train, test_size, step, pct_embargo), evaluate)


def run_cross_validation(spark: SparkSession, starts: np.ndarray, ends: np.ndarray, evaluate: Evaluator, notes: dict[str, str], *, folds: int, pct_embargo: float = 0.0) -> DataFrame:
    """(split, n, mean, std, sharpe, trained) of each purged fold."""
    check_safeguards(notes)
    return _with_sizes(spark, purged_kfold(starts, ends, folds, pct_embargo), evaluate)


def _with_sizes(spark: SparkSession, splits: Splits, evaluate: Evaluator) -> DataFrame:
    sizes = spark.createDataFrame([(i, len(train)) for i, (train, _) in enumerate(splits)], "split int, trained long")
    return summarize(run_splits(spark, splits, evaluate)).join(F.broadcast(sizes), "split")


def path_distribution(returns: DataFrame, n: int, groups: int, paths: list[dict[int, int]]) -> DataFrame:
    """(path, n, mean, std, sharpe) of combinatorial paths: each path strings together, group by group, the returns
    (split, idx, ret) of the split that it takes the group from."""
    spark = returns.sparkSession
    group = fold_of(n, groups)
    edges = np.searchsorted(group, np.arange(groups + 1)).tolist()
    rows = [(p, s, edges[g], edges[g + 1]) for p, taken in enumerate(paths) for g, s in taken.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "path int, split int, a long, b long"))
    joined = returns.join(pieces, "split").where((F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
    return summarize(joined.select(F.col("path").alias("split"), "ret")).withColumnRenamed("split", "path")


def run_cpcv(spark: SparkSession, starts: np.ndarray, ends: np.ndarray, evaluate: Evaluator, notes: dict[str, str], *, groups: int, test_groups: int, pct_embargo: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Split summaries and the distribution of the Sharpe ratio over paths."""
    check_safeguards(notes)
    splits, _, paths = cpcv(starts, ends, groups, test_groups, pct_embargo)
    returns = run_splits(spark, splits, evaluate)
    return summarize(returns), path_distribution(returns, len(starts), groups, paths)


SAFEGUARDS = ("hypothesis", "data_window", "selection_bias", "costs", "leakage")


def check_safeguards(notes: dict[str, str]) -> None:
    """A backtest has to say how it guards against the five usual faults."""
    if missing := [k for k in SAFEGUARDS if not str(notes.get(k, "")).strip()]:
        raise ValueError(f"missing safeguards: {missing}")


# Scores and search


def score(y: np.ndarray, prob: np.ndarray, scoring: str = "neg_log_loss", weight: np.ndarray | None = None) -> float:
    """accuracy, balanced_accuracy, f1 (at 0.5) or neg_log_loss, weighted."""
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
    if not len(y) or w.sum() <= 0:
        raise ValueError("nothing to score")
    pred = prob >= 0.5
    right = pred == (y == 1)
    if scoring == "accuracy":
        return float((w * right).sum() / w.sum())
    if scoring == "balanced_accuracy":
        parts = [(w * right)[y == c].sum() / w[y == c].sum() for c in (0, 1) if w[y == c].sum() > 0]
        return float(np.mean(parts))
    if scoring == "f1":
        tp, fp, fn = ((w * m).sum() for m in (pred & (y == 1), pred & (y != 1), ~pred & (y == 1)))
        return float(2 * tp / (2 * tp + fp + fn)) if tp > 0 else 0.0
    if scoring == "neg_log_loss":
        p = np.clip(prob, 1e-15, 1 - 1e-15)
        return float((w * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / w.sum())
    raise ValueError(f"unknown scoring {scoring!r}")


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations, in order of the parameter names."""
    out: list[dict] = [{}]
    for name in sorted(grid):
        if not grid[name]:
            raise ValueError(f"no values for {name}")
        out = [p | {name: v} for p in out for v in grid[name]]
    return out


def draw_params(space: dict[str, tuple], n: int, seed: int) -> list[dict]:
    """Draws from ("choice", values), ("uniform", a, b), ("log_uniform", a, b) and ("int", a, b)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        one = {}
        for name in sorted(space):
            kind, *args = space[name]
            if kind == "choice":
                one[name] = args[0][int(rng.integers(len(args[0])))]
            elif kind == "uniform":
                one[name] = float(rng.uniform(*args))
            elif kind == "log_uniform":
                if not 0 < args[0] < args[1]:
                    raise ValueError("log-uniform bounds must be positive and ordered")
                one[name] = float(np.exp(rng.uniform(math.log(args[0]), math.log(args[1]))))
            elif kind == "int":
                one[name] = int(rng.integers(args[0], args[1] + 1))
            else:
                raise ValueError(f"unknown distribution {kind!r}")
        out.append(one)
    return out


def cross_val_scores(spark: SparkSession, build: Callable[[], object], x: np.ndarray, y: np.ndarray, splits: Splits, scoring: str = "neg_log_loss", weight: np.ndarray | None = None) -> DataFrame:
    """(split, score) of one model, a task for each split."""
    return _scores(spark, lambda _: build(), [{}], x, y, splits, scoring, weight).select("split", "score")


def search(spark: SparkSession, build: Callable[[dict], object], params: list[dict], x: np.ndarray, y: np.ndarray, splits: Splits, scoring: str = "neg_log_loss", weight: np.ndarray | None = None) -> tuple[dict, DataFrame]:
    """Scores every parameter set on every split; the best mean score wins, the last on ties."""
    means = _scores(spark, build, params, x, y, splits, scoring, weight).groupBy("params").agg(F.avg("score").alias("score"))
    best = max(means.collect(), key=lambda r: (r["score"], r["params"]))
    return params[best["params"]], means


def _scores(spark: SparkSession, build: Callable[[dict], object], params: list[dict], x: np.ndarray, y: np.ndarray, splits: Splits, scoring: str, weight: np.ndarray | None) -> DataFrame:
    """(params, split, score): one task for each pair."""
    pairs = [(i, j) for i in range(len(params)) for j in range(len(splits))]
    table = spark.createDataFrame(pairs, "params int, split int").repartition(max(1, len(pairs)), "params", "split")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                train, test = splits[r["split"]]
                model = build(params[r["params"]])
                model.fit(x[train], y[train], None if weight is None else weight[train])
                value = score(y[test], model.predict_proba(x[test]), scoring, None if weight is None else weight[test])
                yield pa.RecordBatch.from_arrays([pa.array([r["params"]], pa.int32()), pa.array([r["split"]], pa.int32()), pa.array([value])], ["params", "split", "score"])

    return table.mapInArrow(run, "params int, split int, score double")


class LinearProbability:
    """Weighted ridge regression of a 0/1 target, cut to probabilities."""

    def __init__(self, ridge: float = 1e-3):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> LinearProbability:
        a = np.column_stack([np.ones(len(x)), x])
        w = np.ones(len(x)) if weight is None else weight
        self.coef = np.linalg.solve((a * w[:, None]).T @ a + self.ridge * np.eye(a.shape[1]), (a * w[:, None]).T @ y)
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.coef[0] + x @ self.coef[1:], 1e-6, 1 - 1e-6)


def fit_linear_probability(df: DataFrame, features: list[str], y: str, weight: str | None = None, ridge: float = 1e-3) -> np.ndarray:
    """The same coefficients for any number of rows: one aggregate of the normal equations, solved on the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    columns = [F.lit(1.0), *map(F.col, features)]
    k = len(columns)
    sums = [F.sum(w * columns[i] * columns[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * c * F.col(y)) for c in columns]
    row = [float(v or 0) for v in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = row[: k * (k + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    return np.linalg.solve(gram + ridge * np.eye(k), np.array(row[k * (k + 1) // 2 :]))
