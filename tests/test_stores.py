"""Tables kept by run and by key hash, numbered uploads and malformed records."""

import datetime as dt
import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from retention.operators import model
from retention.operators.keyed_store import KeyedStore
from retention.schema import METRICS_SCHEMA
from retention.session import scratch_path
from retention.sources import run_log, uploads

T0 = dt.datetime(2024, 1, 1)


def _metrics(spark, run, models=("m",), day=0, value=0.8):
    return spark.createDataFrame([(m, T0 + dt.timedelta(days=day), value, value, value, value, "1", run) for m in models], METRICS_SCHEMA)


def test_a_repeated_run_leaves_one_copy(spark):
    path = scratch_path(spark, "runs")
    assert run_log.read_runs(spark, path, METRICS_SCHEMA).count() == 0
    for run, value in (("2024", 0.8), ("a b/c=%", 0.7), ("2024", 0.9)):  # ids that look like numbers or paths stay as they are
        run_log.append_run(_metrics(spark, run, value=value), path, run)
    got = {r.run_id: r.accuracy for r in run_log.read_runs(spark, path, METRICS_SCHEMA).collect()}
    assert got == {"2024": 0.9, "a b/c=%": 0.7}
    assert run_log.drop_runs(spark, path, ["a b/c=%", "none"]) == 1
    assert [r.run_id for r in run_log.read_runs(spark, path, METRICS_SCHEMA).collect()] == ["2024"]
    with pytest.raises(ValueError):
        run_log.append_run(_metrics(spark, "x"), path, "")


def test_runs_at_once_lose_nothing(spark):
    path = scratch_path(spark, "runs")
    failed = []

    def one(k):
        try:
            run_log.append_run(_metrics(spark, f"r{k}", day=k), path, f"r{k}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(r.run_id for r in run_log.read_runs(spark, path, METRICS_SCHEMA).collect()) == [f"r{k}" for k in range(6)]


def test_retention_drops_whole_runs(spark):
    path = scratch_path(spark, "runs")
    for k in range(5):
        run_log.append_run(_metrics(spark, f"r{k}", ["busy", "rare"] if k == 0 else ["busy"], k), path, f"r{k}")
    assert run_log.retain_runs(spark, path, METRICS_SCHEMA, 2) == ["r1", "r2"]  # r0 has the only run of a model
    left = sorted((r.model_id, r.run_id) for r in run_log.newest_metrics(spark, path, METRICS_SCHEMA, 2).collect())
    assert left == [("busy", "r3"), ("busy", "r4"), ("rare", "r0")]
    assert run_log.retain_runs(spark, path, METRICS_SCHEMA, 2) == []


def test_alert_history(spark):
    path = scratch_path(spark, "alerts")
    row = lambda m, kind, sev: (m, kind, sev, None, 0.5, 0.8, "text", {"a": "b"})
    schema = run_log.ALERT_SCHEMA.split(", ts timestamp")[0]
    runs = [[row("m", "LOW", "WARNING"), row(None, "DATA_DRIFT", "CRITICAL")], [], [row("m", "LOW", "CRITICAL")]]
    for k in (0, 1, 2, 2):
        run_log.append_alerts(spark.createDataFrame(runs[k], schema), path, f"r{k}", T0 + dt.timedelta(days=k))
    rows = sorted((r.type, r.run_id, r.times, r.first_ts) for r in run_log.alert_history(spark, path).collect())
    assert rows == [("DATA_DRIFT", "r0", 1, T0), ("LOW", "r0", 1, T0), ("LOW", "r2", 2, T0)]
    late = run_log.alert_history(spark, path, since=T0 + dt.timedelta(days=1), severities=["CRITICAL"]).collect()
    assert [(r.type, r.times, r.details) for r in late] == [("LOW", 2, {"a": "b"})]
    assert run_log.alert_history(spark, path + "-none").count() == 0


def test_current_models(spark):
    path = scratch_path(spark, "registry")
    rows = [("a", "p1", "1", T0, True), ("a", "p2", "2", T0 + dt.timedelta(days=1), False), ("b", "p3", "1", T0, False)]
    model.register_run(spark.createDataFrame(rows, "model_id string, model_path string, model_version string, ts timestamp, passed boolean"), path, "r1")
    registry = model.read_registry(spark, path)
    assert registry.count() == 3 and [tuple(r) for r in model.current_models(registry).collect()] == [("a", "p1", "1", T0)]


HEADER = "Customer ID,Gender,Monthly Charges"


def _folder(spark, files):
    path = scratch_path(spark, "upload")
    os.makedirs(path)
    for name, text in files.items():
        with open(os.path.join(path, name), "w", newline="") as f:
            f.write(text)
    return path


@pytest.mark.parametrize("split", ["128m", "300"])
def test_row_numbers_do_not_depend_on_splits(spark, split):
    lines = [f"C{k},Male,{k}.5" for k in range(400)]
    path = _folder(spark, {"b.csv": HEADER + "\n" + "\n".join(lines[150:]), "a.csv": "\n" + HEADER + "\r\n\r\n" + "\r\n".join(lines[:150]) + "\r\n\r\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows, malformed = uploads.read_upload(spark, path)
        got = {r.customer_index: (r.customer_id, r.monthly_charges) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (f"C{k}", k + 0.5) for k in range(400)} and malformed.count() == 0


def test_every_line_is_accounted_for(spark):
    path = _folder(spark, {
        "a.csv": HEADER + '\nC0,Male,10\nC1,Fem"ale,20\nC2,Male\nC3,Male,30,x\n"C,4",Female,5.5\n"C""5",Male,\n',
        "b.csv": "﻿Gender,odd.name,Tenure Months\nMale,z,3\n,y,x\n", "c.csv": HEADER + "\n"})
    rows, malformed = uploads.read_upload(spark, path)
    assert [(r.customer_index, r.malformed, r.record) for r in malformed.orderBy("customer_index").collect()] == [
        (1, "open_quote", 'C1,Fem"ale,20'), (2, "wrong_number_of_fields", "C2,Male"), (3, "wrong_number_of_fields", "C3,Male,30,x")]
    got = [(r.customer_index, r.customer_id, r.gender, r.monthly_charges, r.tenure_months) for r in rows.orderBy("customer_index").collect()]
    assert got == [(0, "C0", "Male", 10.0, 0), (4, "C,4", "Female", 5.5, 0), (5, 'C"5', "Male", None, 0),
                   (6, "AUTO_6", "Male", 0.0, 3), (7, "AUTO_7", None, 0.0, None)]
    errors = {r.customer_index: (r.customer_id, r.error) for r in uploads.upload_errors(rows, malformed).collect()}
    assert errors[2] == ("unknown", "malformed_wrong_number_of_fields") and errors[7][1].startswith("missing_gender") and set(errors) >= {1, 2, 3, 5, 7}


def test_upload_without_rows(spark):
    rows, malformed = uploads.read_upload(spark, _folder(spark, {"a.csv": HEADER + "\n"}))
    assert rows.count() == 0 and malformed.count() == 0
    rows, malformed = uploads.read_upload(spark, _folder(spark, {"a.csv": "\n \n"}))
    assert rows.count() == 0 and malformed.count() == 0 and "customer_index" in rows.columns


def _store(spark, n=200, parts=16):
    base = spark.range(n).select(F.format_string("CUST-%04d", "id").alias("customer_id"), F.col("id").alias("v"))
    return KeyedStore(spark, scratch_path(spark, "keyed")).create(base, parts)


def _files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.path.removeprefix('file:')}/part=*/*.parquet")}


def test_untouched_parts_are_neither_read_nor_written(spark):
    store = _store(spark)
    before = _files(store)
    change = spark.createDataFrame([("CUST-0003", 1000, 1), ("CUST-0003", 2000, 2)], "customer_id string, v long, seq long")
    touched = store.upsert(change, "seq", "one")
    assert len(touched) == 1
    after = _files(store)
    same = {f for f in before if f"part={touched[0]}/" not in f}
    assert same and all(after.get(f) == before[f] for f in same) and not {f for f in after if f"part={touched[0]}/" in f} & set(before)
    assert "PartitionFilters: []" not in store.read(touched)._jdf.queryExecution().executedPlan().toString()
    got = {r.customer_id: r.v for r in store.read().collect()}
    assert len(got) == 200 and got["CUST-0003"] == 2000 and got["CUST-0004"] == 4


def test_a_merge_does_not_need_the_other_parts(spark):
    store = _store(spark)
    change = spark.createDataFrame([("CUST-0003", 1000, 1)], "customer_id string, v long, seq long")
    part = store.update_existing(change, "seq", "one")[0]
    for f in _files(store):
        if f"part={part}/" not in f:
            with open(f, "w") as out:
                out.write("not a table")
    store.update_existing(change.withColumn("v", F.lit(2000)), "seq", "two")
    assert store.read([part]).filter("customer_id = 'CUST-0003'").first().v == 2000


def test_a_repeated_batch_changes_nothing(spark):
    store = _store(spark)
    new = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("CUST-0500", 3, 3)], "customer_id string, v long, seq long")
    for _ in range(2):
        store.upsert(new, "seq", "signups")
    got = sorted((r.customer_id, r.v) for r in store.read().filter("v < 4 and customer_id > 'CUST-0199'").collect())
    assert got == [("CUST-0500", 3), ("CUST-0501", 1), ("CUST-0502", 2)]
    gone = spark.createDataFrame([(f"CUST-{k:04d}",) for k in range(200)], "customer_id string")
    for _ in range(2):
        store.delete(gone, "clear")
    assert sorted(r.customer_id for r in store.read().collect()) == ["CUST-0500", "CUST-0501", "CUST-0502"]


def test_a_batch_that_failed_while_publishing_is_published_again(spark, monkeypatch):
    store = _store(spark)
    change = spark.createDataFrame([(f"CUST-{k:04d}", -1, 1) for k in range(0, 200, 3)], "customer_id string, v long, seq long")
    publish = KeyedStore._publish

    def dies(self, staged, numbers):
        publish(self, staged, numbers)  # in force, but the batch was never marked as published
        for f in _files(self):
            if f"part={numbers[0]}/" in f:
                os.remove(f)  # and one part was lost on the way
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedStore, "_publish", dies)
    with pytest.raises(RuntimeError):
        store.update_existing(change, "seq", "b")
    monkeypatch.setattr(KeyedStore, "_publish", publish)
    store.update_existing(change, "seq", "b")
    got = {r.customer_id: r.v for r in store.read().collect()}
    assert len(got) == 200 and all((v == -1) == (int(k[5:]) % 3 == 0) for k, v in got.items())


def test_id_ranges_of_interleaved_batches(spark):
    store = _store(spark, 10)
    other = KeyedStore(spark, store.root)
    assert store.reserve("a", 5) == 9 and other.reserve("b", 3) == 14 and store.reserve("a", 5) == 9
    assert other.reserve("c", 2, at_least=100) == 100 and store.reserve("d", 1) == 102
    with pytest.raises(ValueError):
        store.reserve("x/y", 1)


def test_empty_store(spark):
    store = KeyedStore(spark, scratch_path(spark, "keyed")).create(spark.createDataFrame([], "customer_id string, v long"), 4)
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([(None, 7, 1)], "customer_id string, v long, seq long"), "seq", "first")
    assert [tuple(r) for r in store.read().collect()] == [("CUST-0001", 7)]
    assert store.delete(spark.createDataFrame([], "customer_id string"), "none") == []
