"""Typed frames of results, and chart payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _frame(spark: SparkSession, columns: dict[str, tuple[str, list | None]]) -> DataFrame:
    given = {n: (t, list(v)) for n, (t, v) in columns.items() if v is not None}
    lengths = {len(v) for _, v in given.values()}
    if len(lengths) > 1:
        raise ValueError(f"columns differ in length: { {n: len(v) for n, (_, v) in given.items()} }")
    rows = list(zip(*(v for _, v in given.values()), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, (t, _) in given.items()))


def signal_frame(spark, ts, signal, side=None, symbol: str | None = None) -> DataFrame:
    out = _frame(spark, {"ts": ("timestamp_ntz", ts), "signal": ("double", signal), "side": ("double", side)})
    return out if symbol is None else out.withColumn("symbol", F.lit(symbol))


def event_frame(spark, starts, ends, probs, sides=None, labels=None) -> DataFrame:
    return _frame(spark, {"start_ts": ("timestamp_ntz", starts), "end_ts": ("timestamp_ntz", ends), "prob": ("double", probs), "side": ("double", sides), "label": ("int", labels)})


def weights_frame(spark, assets, weights, as_of: str | None = None) -> DataFrame:
    out = _frame(spark, {"asset": ("string", assets), "weight": ("double", weights)})
    return out if as_of is None else out.withColumn("as_of", F.lit(as_of))


def frontier_frame(spark, volatility, returns, sharpe=None, point_ids=None) -> DataFrame:
    ids = point_ids if point_ids is not None else [str(i) for i in range(len(volatility))]
    return _frame(spark, {"volatility": ("double", volatility), "return": ("double", returns), "sharpe": ("double", sharpe), "point_id": ("string", ids)})


def backtest_frame(spark, ts, equity, returns=None, positions=None) -> DataFrame:
    return _frame(spark, {"ts": ("timestamp_ntz", ts), "equity": ("double", equity), "returns": ("double", returns), "position": ("double", positions)})


def indicator_frame(ind: DataFrame, labels: list[str]) -> DataFrame:
    """bar_index and one 0/1 column for each label, of the long indicator matrix (bar, label)."""
    wide = ind.withColumn("one", F.lit(1)).groupBy(F.col("bar").alias("bar_index")).pivot("label", labels).agg(F.max("one"))
    return wide.na.fill(0)


class SignalBuffer:
    """Signal frames gathered one by one."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def append(self, frame: DataFrame) -> None:
        self.parts.append(frame)

    def frame(self) -> DataFrame:
        if not self.parts:
            raise ValueError("the buffer is empty")
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def clear(self) -> None:
        self.parts.clear()


# Chart payloads


#: Charts and the keys under which their clients look for columns, required ones first; keys of optional
#: columns are in brackets, a constant that goes with an optional column follows it.
CHARTS = {
    "importance": ("bar", ["x", "y", "[error_y]"], {"y_label": "importance"}),
    "drawdown": ("line", ["x", "equity", "drawdown"], {"y_label": "drawdown"}),
    "regime": ("line+step", ["x", "score", "regime"], {}),
    "frontier": ("scatter", ["x", "y", "[color]"], {"x_label": "volatility", "y_label": "return", "color_label": "[color]sharpe"}),
    "cluster": ("tree", ["node_id", "parent_id", "[height]"], {}),
    "side": (None, ["labels", "values"], {}),
}


def payload(kind: str, columns: list, **more) -> dict:
    """The chart of a kind from its columns, in the order of CHARTS; an optional column may be None."""
    chart, keys, constants = CHARTS[kind]
    out: dict = {} if chart is None else {"chart": chart}
    for key, column in zip(keys, [*columns, *[None] * (len(keys) - len(columns))], strict=True):
        if column is not None:
            out[key.strip("[]")] = list(column)
        elif not key.startswith("["):
            raise ValueError(f"{kind} needs {key}")
    sizes = {k: len(v) for k, v in out.items() if isinstance(v, list)}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of one chart have different lengths: {sizes}")
    for key, text in constants.items():
        needs, _, label = text.rpartition("]")
        if not needs or needs.strip("[") in out:
            out[key] = label
    return out | more


def top_features(importance: DataFrame, n: int | None = None) -> DataFrame:
    """(feature, importance[, std]) from the largest down."""
    out = importance.orderBy(F.desc("importance"), "feature")
    return out if n is None else out.limit(n)


def importance_payload(importance: DataFrame, top_n: int | None = None) -> dict:
    rows = top_features(importance, top_n).collect()
    return payload("importance", [[r[c] for r in rows] for c in ("feature", "importance", "std") if c in importance.columns])


def comparison_payload(left: tuple[str, list, list], right: tuple[str, list, list]) -> dict:
    return {"chart": "grouped_bar"} | {k: payload("side", list(s[1:]), name=s[0]) for k, s in (("left", left), ("right", right))}


def write_importance(importance: DataFrame, path: str, *, oob: float, oos: float) -> None:
    """One CSV file with the scores out of bag and out of sample beside each feature's mean and deviation."""
    rows = importance.select(F.lit(oob).alias("oob_score"), F.lit(oos).alias("oos_score"), "feature", "mean", F.col("std_error").alias("std"))
    rows.orderBy("feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def effect_lines(effects: DataFrame) -> list[str]:
    """One line of text for each feature's effects, the largest linear one first; features are few."""
    shown = [c for c in effects.columns if c != "feature"]
    rows = effects.orderBy(F.desc(shown[0]), "feature").collect()
    return [f"{r['feature']}: " + ", ".join(f"{c} {r[c]:.6g}" for c in shown) for r in rows]


def drawdown_curve(curve: DataFrame) -> DataFrame:
    """(symbol, ts, equity, drawdown)."""
    top = F.max("equity").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return curve.select("symbol", "ts", "equity", (F.try_divide(F.col("equity"), top) - 1).alias("drawdown"))


def drawdown_payload(curve: DataFrame) -> dict:
    rows = drawdown_curve(curve).orderBy("ts").collect()
    return payload("drawdown", [[str(r["ts"]) for r in rows], [r["equity"] for r in rows], [r["drawdown"] for r in rows]])


def regime(score: str, threshold: float = 0.0):
    """1 at or above the threshold, -1 below it."""
    return F.when(F.col(score) >= threshold, 1).otherwise(-1)


def regime_payload(ts: list, scores: list[float], threshold: float = 0.0) -> dict:
    return payload("regime", [ts, scores, [1 if s >= threshold else -1 for s in scores]], threshold=threshold)


def frontier_payload(volatility: list, returns: list, sharpe: list | None = None) -> dict:
    return payload("frontier", [volatility, returns, sharpe])


def cluster_payload(node_id: list, parent_id: list, height: list | None = None) -> dict:
    return payload("cluster", [node_id, parent_id, height])
