"""Cleaning, projection and predicates (P1-P8) and the validation split (V1, V8, V9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validation import breaks_any_rule, coerce_column, error_codes, error_text, impute_total_charges
from ..schema import RECORD_COLUMNS, REQUIRED_COLUMNS


class EmptyBatchError(ValueError):
    pass


class BatchTooLargeError(ValueError):
    pass


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names, spaces to underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def coerce_types(df: DataFrame) -> DataFrame:
    """Type every known subscriber column; other columns pass through unchanged."""
    known = set(RECORD_COLUMNS)
    return df.select(*[coerce_column(df, c) if c in known else F.col(c) for c in df.columns])


def impute(df: DataFrame) -> DataFrame:
    """Fill missing total charges from monthly x tenure."""
    return df.withColumn("total_charges", impute_total_charges())


def to_record(df: DataFrame) -> DataFrame:
    """Project to the record fields; timestamps become ISO-8601 text."""
    cols = []
    for c in RECORD_COLUMNS:
        if c in ("created_at", "updated_at"):
            src = F.col(c) if c in df.columns else F.lit(None).cast("timestamp")
            cols.append(F.date_format(src, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c))
        else:
            cols.append(F.col(c) if c in df.columns else F.lit(None).alias(c))
    return df.select(*cols)


def from_record(df: DataFrame) -> DataFrame:
    """P3 inverse: ISO text back to timestamps and every field typed."""
    return coerce_types(df.select(*[c for c in RECORD_COLUMNS if c in df.columns]))


def find_by_id(df: DataFrame, customer_id: str) -> DataFrame:
    """Point lookup, first match (the equality filter is pushed to the scan)."""
    return df.filter(F.col("customer_id") == F.lit(customer_id)).limit(1)


def find_all(df: DataFrame, limit: int | None = None) -> DataFrame:
    """P5: valid rows only (rows failing conversion are left out), optional limit."""
    ok, _ = validate(df)
    return ok.limit(limit) if limit is not None else ok


def find_churned(df: DataFrame) -> DataFrame:
    """Known churned subscribers (null labels excluded)."""
    return df.filter(F.col("churn") == F.lit(True))


def find_active(df: DataFrame) -> DataFrame:
    """Known active subscribers (null labels excluded)."""
    return df.filter(F.col("churn") == F.lit(False))


def filter_results(df: DataFrame, predictions=None, risk_levels=None) -> DataFrame:
    """Keep scored rows whose prediction and risk level are in the chosen sets."""
    cond = F.lit(True)
    if predictions is not None:
        cond = cond & F.col("prediction").isin(*list(predictions))
    if risk_levels is not None:
        cond = cond & F.col("risk_level").isin(*list(risk_levels))
    return df.filter(cond)


def _with_required(df: DataFrame) -> DataFrame:
    """A missing required column fails every row; keep the rows and say why."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns and c != "churn"]
    if missing:
        df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
    return df


def with_errors(df: DataFrame) -> DataFrame:
    """All rows with an ``errors`` array of rule codes (empty for valid rows)."""
    return _with_required(df).withColumn("errors", error_codes())


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1: split into (valid rows, quarantined rows).

    The valid side is a plain predicate (no rule fires), so the common path builds no
    per-row array; only quarantined rows get ``error`` (their codes joined by ',').
    Callers that consume both sides of a large input should ``persist`` it first."""
    full = _with_required(df)
    broken = breaks_any_rule()
    ok = full.filter(~broken).select(*df.columns)
    bad = full.filter(broken).withColumn("error", error_text())
    return ok, bad.select(*df.columns, "error")


def require_not_empty(df: DataFrame) -> DataFrame:
    """V8: error on an empty batch (reads at most one row)."""
    if df.isEmpty():
        raise EmptyBatchError("batch has no rows")
    return df


def check_batch_size(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """V9: optional request guard; counts at most ``max_rows + 1`` rows."""
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise BatchTooLargeError(f"batch has more than {max_rows} rows")
    return df
