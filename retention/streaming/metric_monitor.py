"""M6-M8 as a stateful stream: degradation, trend and alerts as training runs arrive in the metric log.

The state of a model is its newest runs (the recent window and the baseline before it), how many runs
it has, and a 64-bit hash of every run id seen, which is what tells a repeated run from a new one.  Runs
may arrive late, in any order and more than once: a late run takes its place by time, and a repeated one
replaces its metrics but not its time, so the outcome is that of ``performance_degradation`` over the log.
The state grows by 8 bytes a run; a model's history never meets in one task again.

Each micro-batch gives the newest runs of the models that it touched, and the same expressions as in
batch turn them into a row a model and its alerts, under ``<out>/degradation/epoch=<id>`` and
``<out>/alerts/epoch=<id>``; a retried epoch replaces its own output."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Thresholds
from ..operators.monitoring import PERF_METRICS, alerts, degradation_of_newest
from ..schema import METRICS_SCHEMA

_RUN = ["ts", "run_id", *PERF_METRICS]
_NEWEST = "model_id string, data_points long, ts timestamp, run_id string, " + ", ".join(f"{m} double" for m in PERF_METRICS)
_STATE = "seen binary, micros array<long>, run_ids array<string>, " + ", ".join(f"{m} array<double>" for m in PERF_METRICS)
DEGRADATION, ALERTS = "degradation", "alerts"


def _merge(keep: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The model's ``keep`` newest runs after the batch, newest first."""
        seen, runs = np.zeros(0, np.uint64), {}
        if state.exists:
            held, micros, run_ids, *metrics = state.get
            seen = np.frombuffer(bytes(held), np.uint64)
            runs = {r: (t, *values) for r, t, *values in zip(run_ids, micros, *metrics, strict=True)}
        rows = pd.concat(batches).sort_values(["run_id", "micros", *PERF_METRICS]).drop_duplicates("run_id")
        hashes = rows["run_hash"].to_numpy(np.int64).view(np.uint64)
        known = np.isin(hashes, seen)
        for again, row in zip(known, rows[["run_id", "micros", *PERF_METRICS]].itertuples(index=False), strict=True):
            run_id, micros, *values = row
            values = [None if pd.isna(v) else float(v) for v in values]
            if run_id in runs:
                runs[run_id] = (runs[run_id][0], *values)
            elif not again:  # a run seen before and not held is older than those held
                runs[run_id] = (int(micros), *values)
        seen = np.union1d(seen, hashes)
        newest = sorted(runs, key=lambda r: (runs[r][0], r), reverse=True)[:keep]
        runs = {r: runs[r] for r in newest}
        columns = list(zip(*runs.values(), strict=True))
        state.update((seen.tobytes(), list(columns[0]), list(runs), *[list(c) for c in columns[1:]]))
        out = pd.DataFrame({"model_id": key[0], "data_points": len(seen), "ts": pd.to_datetime(list(columns[0]), unit="us"), "run_id": list(runs)})
        for name, values in zip(PERF_METRICS, columns[1:], strict=True):
            out[name] = np.array(values, np.float64)
        yield out

    return run


def newest_runs(log: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Of a streamed metric log, the runs that count now for each model that a micro-batch touched.  Rows
    without a model or run id, or without a time, are no runs.  Of one run's rows in a batch, the one with
    the least time, then metrics, counts; of those in different batches, the last."""
    rows = log.filter("model_id IS NOT NULL AND run_id IS NOT NULL AND ts IS NOT NULL").select(
        "model_id", "run_id", F.unix_micros("ts").alias("micros"), F.xxhash64("run_id").alias("run_hash"), *[F.col(m).cast("double").alias(m) for m in PERF_METRICS])
    return rows.groupBy("model_id").applyInPandasWithState(
        _merge(t.recent_window * (1 + t.baseline_windows)), _NEWEST, _STATE, "update", GroupStateTimeout.NoTimeout)


def start_metric_monitor(spark: SparkSession, log_dir: str, output_dir: str, checkpoint_dir: str, t: Thresholds = DEFAULT,
                         max_files_per_trigger: int = 1000, processing_time: str | None = None):
    """Follow the Parquet metric log in ``log_dir``; until it is read up, or for ever every ``processing_time``."""
    log = spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_dir)

    def write_epoch(newest: DataFrame, epoch: int) -> None:
        # a few rows for each touched model; both outputs read them
        held = newest.persist()
        try:
            place = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("ts"), F.desc("run_id")))
            found = degradation_of_newest(held.withColumn("rn", place), t)
            found.write.mode("overwrite").parquet(os.path.join(output_dir, DEGRADATION, f"epoch={epoch}"))
            raised = alerts(None, found, None, None, t)
            raised.write.mode("overwrite").parquet(os.path.join(output_dir, ALERTS, f"epoch={epoch}"))
        finally:
            held.unpersist()

    stream = newest_runs(log, t).writeStream.outputMode("update").foreachBatch(write_epoch).option("checkpointLocation", checkpoint_dir)
    return (stream.trigger(processingTime=processing_time) if processing_time else stream.trigger(availableNow=True)).start()


def latest_degradation(spark: SparkSession, output_dir: str) -> DataFrame:
    """Where each model stands after the epochs written so far (max_by is a partial aggregate)."""
    every = spark.read.parquet(os.path.join(output_dir, DEGRADATION))
    own = [c for c in every.columns if c != "epoch"]
    return every.groupBy("model_id").agg(F.max_by(F.struct(*own), "epoch").alias("row")).select("row.*")


def raised_alerts(spark: SparkSession, output_dir: str) -> DataFrame:
    """Every alert with the epoch in which it arose."""
    return spark.read.parquet(os.path.join(output_dir, ALERTS))
