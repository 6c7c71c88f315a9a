"""Tables appended to by runs (S6 metric log, M8 alert history, T10 registry): one partition a run.

``append_run`` writes only its own run's partition, replaced as a whole when the run is repeated, so a
retry leaves one copy and two runs at once don't touch each other's rows; nothing stored is read or
written again.  Readers prune by run; retention drops whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from .readers import _exists
from .writers import retain_newest

RUN = "run_id"


def append_run(rows: DataFrame, path: str, run_id: str) -> str:
    """Store ``rows`` as run ``run_id``.  A column of that name is replaced by the run's id.  A run
    without rows stores nothing, and leaves an earlier try's rows in place."""
    if not run_id:
        raise ValueError("run_id must not be empty")
    (rows.withColumn(RUN, F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN).parquet(path))
    return path


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All stored runs in the columns of ``schema`` (which names ``run_id``); empty where nothing is
    stored yet.  Columns that a run's rows lack are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def drop_runs(spark: SparkSession, path: str, run_ids: list[str]) -> int:
    """Remove the partitions of the given runs; how many there were."""
    jvm = spark.sparkContext._jvm
    gone = 0
    for run in run_ids:
        # the folder name as Spark writes it
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run)
        part = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{RUN}={name}")
        gone += bool(part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True))
    return gone


def retain_runs(spark: SparkSession, path: str, schema: T.StructType | str, keep: int = DEFAULT.keep_metrics) -> list[str]:
    """Drop the runs of which no row is among the newest ``keep`` of its model; returns their ids.

    Only model, time and run are read; run ids (one row a run) come to the driver."""
    log = read_runs(spark, path, schema).select("model_id", "ts", RUN)
    needed = retain_newest(log, keep).select(RUN).distinct()
    old = sorted(r[RUN] for r in log.select(RUN).distinct().join(needed, RUN, "left_anti").collect())
    drop_runs(spark, path, old)
    return old


def newest_metrics(spark: SparkSession, path: str, schema: T.StructType | str, keep: int = DEFAULT.keep_metrics) -> DataFrame:
    """S6 as stored by run: the newest ``keep`` rows of each model."""
    return retain_newest(read_runs(spark, path, schema), keep)


ALERT_SCHEMA = ("model_id string, type string, severity string, metric string, value double, threshold double, message string, "
                "details map<string,string>, ts timestamp, run_id string")


def append_alerts(alerts: DataFrame, path: str, run_id: str, ts) -> str:
    """M8: the alerts of one run with its time.  A run without alerts stores none."""
    return append_run(alerts.withColumn("ts", F.lit(ts).cast("timestamp")), path, run_id)


def alert_history(spark: SparkSession, path: str, since=None, severities: list[str] | None = None) -> DataFrame:
    """M8: every stored alert with the run and time it arose, how many runs raised it so far
    (``times``, this one included) and when that alert was raised first."""
    from pyspark.sql import Window

    log = read_runs(spark, path, ALERT_SCHEMA)
    same = Window.partitionBy("model_id", "type", "metric")
    log = log.withColumns({
        "first_ts": F.min("ts").over(same),
        "times": F.count(F.lit(1)).over(same.orderBy("ts", RUN).rowsBetween(Window.unboundedPreceding, 0)),
    })
    if since is not None:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return log.filter(F.col("severity").isin(*severities)) if severities else log
