"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the no-op sink (no collect to the driver).  The
derived subscriber table is materialised first and timed separately.  Prints one JSON
line: {"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = [a for a in sys.argv[1:]]
    from retention import fixtures
    from retention.plans.catalog import load_all
    from retention.session import local_session

    # small inputs: one shuffle partition per core (AQE coalesces further where it can)
    event_dir, extra = None, {}
    if os.environ.get("BENCH_EVENT_LOG"):
        # per-query jobs / stages / shuffle bytes from Spark's event log (a fresh scratch folder)
        event_dir = tempfile.mkdtemp(prefix="retention-events-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir}
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="retention-bench", extra_conf=extra)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    fixtures.subscribers(spark, sf_dir).count()
    times["prepare_subscribers"] = round(time.perf_counter() - t0, 3)
    from retention.plans.q_model import deployed, trained

    t0 = time.perf_counter()
    quality = trained(spark, sf_dir)[1].first().asDict()
    times["train_model"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    deployed(spark, sf_dir)  # T8: save the model to the shared folder and load it back, once
    times["deploy_model"] = round(time.perf_counter() - t0, 3)
    queries = load_all()
    failed = []
    for name in sorted(queries):
        if only and name not in only:
            continue
        t = time.perf_counter()
        spark.sparkContext.setJobGroup(name, name)
        try:
            queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
        except Exception as e:  # noqa: BLE001
            failed.append(f"{name}: {type(e).__name__}")
    # includes train_model and deploy_model; excludes building the stand-in subscriber table
    total = round(sum(v for k, v in times.items() if k != "prepare_subscribers"), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    profile = None
    if event_dir:
        spark.stop()
        profile = event_profile(event_dir)
    print(json.dumps({
        "metric": "total_query_sec", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "failed": failed,
        "model_quality": {k: (round(v, 4) if isinstance(v, float) else v) for k, v in quality.items()},
        **({"profile": profile} if profile else {}),
    }))
    if not event_dir:
        spark.stop()


def _event_lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(path) as f:
            yield from f


def event_profile(event_dir: str) -> dict:
    """Jobs, stages, tasks, shuffle-written MB and input MB per job group (= query)."""
    stage_group: dict[int, str] = {}
    out: dict[str, dict] = {}
    for path in sorted(glob.glob(os.path.join(event_dir, "**", "*"), recursive=True)):
        name = os.path.basename(path)
        if os.path.isdir(path) or not name.startswith(("events_", "local-", "app-")):
            continue
        for line in _event_lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                if not group:
                    continue
                rec = out.setdefault(group, {"jobs": 0, "stages": 0, "tasks": 0, "shuffle_mb": 0.0, "input_mb": 0.0})
                rec["jobs"] += 1
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                group = stage_group.get(info["Stage ID"])
                if group:
                    out[group]["stages"] += 1
                    out[group]["tasks"] += info.get("Number of Tasks", 0)
            elif kind == "SparkListenerTaskEnd":
                group = stage_group.get(ev.get("Stage ID"))
                metrics = ev.get("Task Metrics") or {}
                if group and metrics:
                    sw = metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    ib = metrics.get("Input Metrics", {}).get("Bytes Read", 0)
                    out[group]["shuffle_mb"] += sw / 2**20
                    out[group]["input_mb"] += ib / 2**20
    for rec in out.values():
        rec["shuffle_mb"] = round(rec["shuffle_mb"], 3)
        rec["input_mb"] = round(rec["input_mb"], 3)
    return out


if __name__ == "__main__":
    main()
