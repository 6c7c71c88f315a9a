"""Sources and sinks: text CSV with messy headers and bad cells, missing files,
upload defaults, snapshots, CSV export, metric-log append."""

import os

import pytest
from pyspark.sql import functions as F

from retention.session import scratch_path
from retention.sources import readers, writers

HEADER = ("Customer ID,Gender,Senior Citizen,Partner,Dependents,Phone Service,Multiple Lines,Internet Service,"
          "Online Security,Online Backup,Device Protection,Tech Support,Streaming TV,Streaming Movies,Contract Type,"
          "Paperless Billing,Payment Method,Monthly Charges,Total Charges,Tenure Months,Churn")
ROW_OK = ('CUST-001,Female,No,Yes,No,Yes,No,Fiber optic,No,Yes,No,No,Yes,No,Month-to-month,Yes,'
          'Electronic check,70.35,1510.45,24,No')
ROW_BAD = ('CUST-002,Male,maybe,Yes,No,Yes,No,DSL,No,No,No,No,No,No,One year,No,'
           '"Bank transfer (automatic)",abc,,12.5,Yes')


def _write(tmp, lines):
    os.makedirs(tmp, exist_ok=True)
    with open(os.path.join(tmp, "part-0.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return tmp


def test_csv_text_is_typed_and_bad_cells_become_null(spark):
    path = _write(scratch_path(spark, "csv_in"), [HEADER, ROW_OK, ROW_BAD])
    df = readers.read_subscribers(spark, path, "csv", missing_ok=False)
    rows = {r.customer_id: r for r in df.collect()}
    ok, bad = rows["CUST-001"], rows["CUST-002"]
    assert ok.partner is True and ok.senior_citizen is False and ok.churn is False
    assert ok.monthly_charges == 70.35 and ok.tenure_months == 24
    assert bad.senior_citizen is None and bad.monthly_charges is None and bad.total_charges is None
    assert bad.tenure_months is None and bad.churn is True


def test_missing_file(spark):
    missing = os.path.join(scratch_path(spark, "nothing"), "subscribers.csv")
    assert readers.read_subscribers(spark, missing, "csv").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_subscribers(spark, missing, "csv", missing_ok=False)


def test_upload_defaults_fill_only_absent_columns(spark):
    df = spark.createDataFrame([("Male", 50.0), (None, 60.0)], "gender string, monthly_charges double")
    out = readers.read_with_defaults(df).collect()
    assert [r.gender for r in out] == ["Male", None]  # present column left alone
    assert all(r.contract_type == "Month-to-month" and r.payment_method == "Electronic check" for r in out)
    assert all(r.customer_id.startswith("AUTO_") for r in out) and len({r.customer_id for r in out}) == 2


def test_snapshot_never_overwrites(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    path = writers.write_subscribers(df, scratch_path(spark, "snap"))
    with pytest.raises(Exception):
        writers.write_subscribers(df, path)


def test_results_csv_renders_arrays(spark):
    df = spark.createDataFrame([("A", ["x", "y"])], "customer_id string, recommendations array<string>")
    path = writers.write_results_csv(df, scratch_path(spark, "export"))
    back = spark.read.option("header", True).csv(path).first()
    assert back.recommendations == "x|y"


def test_append_metrics_keeps_newest(spark):
    from retention.schema import METRICS_SCHEMA
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame(
        [("m", t0 + dt.timedelta(days=i), 0.8, 0.8, 0.8, 0.8, "1", f"r{i:02d}") for i in range(4)], METRICS_SCHEMA
    )
    log1 = writers.append_metrics(spark, None, first, scratch_path(spark, "log1"), keep=5)
    new = spark.createDataFrame([("m", t0 + dt.timedelta(days=10), 0.7, 0.7, 0.7, 0.7, "1", "r10"),
                                 ("m", t0 + dt.timedelta(days=11), 0.7, 0.7, 0.7, 0.7, "1", "r11")], METRICS_SCHEMA)
    path1 = log1.inputFiles()[0].rsplit("/", 1)[0]
    log2 = writers.append_metrics(spark, path1, new, scratch_path(spark, "log2"), keep=5)
    assert sorted(r.run_id for r in log2.collect()) == ["r01", "r02", "r03", "r10", "r11"]
