"""Subscriber sources."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import coerce_types, normalize_columns
from ..schema import BOOL_COLUMNS, RAW_SCHEMA, SUBSCRIBER_SCHEMA


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_subscribers(
    spark: SparkSession, path: str, fmt: str = "csv", missing_ok: bool = True, typed: bool = True
) -> DataFrame:
    """S1 (+S2, P1): load a subscriber table from CSV or Parquet.

    CSV is read with a header, every cell as text, in PERMISSIVE mode; names are
    normalised and cells typed by ``coerce_types`` (bad text -> null).  A missing path
    gives an empty table when ``missing_ok`` (repository behaviour) or raises
    (training behaviour)."""
    if not _exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], SUBSCRIBER_SCHEMA)
        raise FileNotFoundError(path)
    if fmt == "csv":
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    df = normalize_columns(df)
    return coerce_types(df) if typed else df


# --- fixed values: defaults for absent columns on the upload path (S3) ------------------
UPLOAD_DEFAULTS = {
    "gender": "Female",
    "senior_citizen": False,
    "partner": False,
    "dependents": False,
    "phone_service": False,
    "multiple_lines": "No",
    "internet_service": "No",
    "online_security": "No",
    "online_backup": "No",
    "device_protection": "No",
    "tech_support": "No",
    "streaming_tv": "No",
    "streaming_movies": "No",
    "contract_type": "Month-to-month",
    "paperless_billing": False,
    "payment_method": "Electronic check",
    "monthly_charges": 0.0,
    "total_charges": 0.0,
    "tenure_months": 0,
}
# --- end of fixed values ----------------------------------------------------------------


def read_with_defaults(df: DataFrame, id_prefix: str = "AUTO_", row_col: str | None = None) -> DataFrame:
    """S3: add absent columns with their defaults; present columns are left alone.

    An absent ``customer_id`` becomes ``AUTO_<n>``: n is the row's number in ``row_col`` where given
    (``uploads.read_upload``), else a unique number."""
    out = df
    for name, value in UPLOAD_DEFAULTS.items():
        if name not in out.columns:
            lit = F.lit(value)
            if name in BOOL_COLUMNS:
                lit = lit.cast("boolean")
            out = out.withColumn(name, lit)
    if "customer_id" not in out.columns:
        out = out.withColumn("customer_id", F.concat(F.lit(id_prefix), (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("string")))
    return out


def read_by_header(spark: SparkSession, lines: DataFrame, id_prefix: str = "AUTO_") -> DataFrame:
    """S2 + P1 + S3 for CSV files whose columns differ: each file is read by its own header, so
    columns may stand in any order and absent ones get their defaults.

    ``lines`` has the text lines of the files: value, file_path, file_block_start.  The files are
    grouped by header line (one row per file on the driver); each layout is read by name."""
    first = (
        lines.filter("file_block_start = 0").withColumn("_at", F.monotonically_increasing_id())
        .groupBy("file_path").agg(F.min_by("value", "_at").alias("header"))
    )
    layouts = first.groupBy("header").agg(F.collect_list("file_path").alias("files")).orderBy("header").collect()
    out = coerce_types(spark.createDataFrame([], RAW_SCHEMA))
    for k, layout in enumerate(layouts):
        files = [unquote(f) for f in layout["files"]]
        rows = coerce_types(normalize_columns(spark.read.option("header", True).csv(files)))
        rows = read_with_defaults(rows, f"{id_prefix}{k}_")
        if "churn" not in rows.columns:
            rows = rows.withColumn("churn", F.lit(None).cast("boolean"))
        out = out.unionByName(rows.select(*RAW_SCHEMA.names))
    return out
