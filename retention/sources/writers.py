"""Sinks (S4-S7): snapshots, CSV export, metric log, drift reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..session import scratch_path
from .readers import _exists


def write_subscribers(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a whole table as a new snapshot (never over the path being read)."""
    w = df.write.mode("errorifexists")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(fmt)
    return path


def write_results_csv(df: DataFrame, path: str) -> str:
    """Export scored rows as CSV with a header (arrays/maps rendered as text)."""
    out = df
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("array", "map", "struct"):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)) if t != "array" else F.array_join(F.col(f.name), "|"))
    out.write.mode("errorifexists").option("header", True).csv(path)
    return path


def retain_newest(log: DataFrame, keep: int = DEFAULT.keep_metrics) -> DataFrame:
    """Newest ``keep`` rows per model.  ``row_number() <= keep`` is planned with a
    per-partition group limit before the shuffle, so a hot model stays cheap."""
    w = Window.partitionBy("model_id").orderBy(F.desc("ts"), F.desc("run_id"))
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def append_metrics(spark: SparkSession, log_path: str | None, new_rows: DataFrame, out_path: str | None = None,
                   keep: int = DEFAULT.keep_metrics) -> DataFrame:
    """Union the stored log with new runs, keep the newest ``keep`` per model, and
    write the result as a new snapshot (returned as a DataFrame over the written data)."""
    log = new_rows
    if log_path and _exists(spark, log_path):
        log = spark.read.parquet(log_path).unionByName(new_rows)
    out_path = out_path or scratch_path(spark, "model_metrics")
    retain_newest(log, keep).write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)


def create_or_load_reference(spark: SparkSession, current: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """The stored reference snapshot, or store ``current`` as the reference.

    Returns (reference, created) - on first run there is nothing to compare against."""
    if _exists(spark, path):
        return spark.read.parquet(path), False
    current.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path), True


def save_bucketed(df: DataFrame, table_name: str, path: str, key: str = "customer_id",
                  buckets: int | None = None) -> DataFrame:
    """Store a keyed table bucketed and sorted by ``key`` (an external table at ``path``).

    Keyed maintenance (upsert / update / delete) then joins against it without
    shuffling the stored side: only the change set is hash-partitioned to match the
    buckets.  Pick ``buckets`` so each bucket file is a few hundred MB."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(table_name)
    return spark.table(table_name)
