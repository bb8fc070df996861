"""Experiments: a TOML configuration becomes a folder of tables, a manifest and a decision."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession

from .pipeline import FlywheelConfig, run_flywheel, run_grid, run_pipeline, synthetic_dataset


def read_config(text: str) -> tuple[str, dict, dict]:
    """(name, dataset options, flywheel options) of a TOML text."""
    doc = tomllib.loads(text)
    run = doc.get("run", {})
    known = {**doc.get("pipeline", {}), **doc.get("costs", {}), **doc.get("gates", {})}
    return run.get("name", "run"), doc.get("dataset", {}), known


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Hadoop's file system, so any store that Spark writes to will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def run_manifest(name: str, config: FlywheelConfig, dataset: dict, options: dict) -> dict:
    """What a run needs to be repeated: its name, the digest of its configuration, its data and options."""
    return {"run_name": name, "config_digest": config.digest(), "dataset": dataset, "options": options}


def run_experiment(spark: SparkSession, config_text: str, out_root: str) -> str:
    """Runs one configuration and writes metrics, events, signals, weights and backtest tables, run_manifest.json and
    decision.md to a folder named after the run and its digest."""
    name, dataset, options = read_config(config_text)
    config = FlywheelConfig().with_values(**options)
    bars, prices = synthetic_dataset(spark, int(dataset.get("n_bars", 192)), int(dataset.get("seed", 7)))
    result = run_pipeline(bars, prices, config.pipeline)
    metrics = run_flywheel(bars, prices, config)
    folder = f"{out_root}/{name}-{config.digest()}"
    tables: dict[str, DataFrame] = {"metrics": metrics, "events": result.events, "signals": result.signals, "weights": result.portfolio.frame(spark), "backtest": result.path}
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    row = spark.read.parquet(f"{folder}/metrics.parquet").first().asDict()
    _write_text(spark, f"{folder}/run_manifest.json", json.dumps(run_manifest(name, config, dataset, options), sort_keys=True, indent=2))
    verdict = "PROMOTE" if row["promote_candidate"] else "HOLD"
    lines = [f"# {name}", "", f"Decision: {verdict}", "", *(f"- {k}: {row[k]}" for k in ("realized_sharpe", "net_sharpe", "turnover", "net_total_return"))]
    _write_text(spark, f"{folder}/decision.md", "\n".join(lines) + "\n")
    return folder


def run_experiment_grid(spark: SparkSession, base_text: str, grid_text: str, out_root: str) -> str:
    """Every [[runs]] entry of the grid over the base configuration: one leaderboard table."""
    name, dataset, options = read_config(base_text)
    runs = tomllib.loads(grid_text).get("runs", [])
    configs = {r.get("name", f"run_{i:02d}"): options | {k: v for k, v in r.items() if k != "name"} for i, r in enumerate(runs)}
    bars, prices = synthetic_dataset(spark, int(dataset.get("n_bars", 192)), int(dataset.get("seed", 7)))
    path = f"{out_root}/{name}-leaderboard.parquet"
    run_grid(bars, prices, configs).coalesce(1).write.mode("overwrite").parquet(path)
    return path
