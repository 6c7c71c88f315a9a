"""Session helpers: a local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "retention",
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on, UTC)."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="retention-warehouse-"))
        .getOrCreate()
    )


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be shared storage; we only
    read it.  Where it is unset (tests, local runs) the context's checkpoint folder is
    used, or one folder is created once per application and registered with
    ``setCheckpointDir`` so ``DataFrame.checkpoint()`` writes there too.  Off local mode a
    machine-local folder would lose data, so an unset folder is an error there."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        master = getattr(sc, "master", "local")
        if sc.getCheckpointDir() is None and master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = sc.getCheckpointDir()
        if current is None:
            current = tempfile.mkdtemp(prefix="retention-ckpt-")
            sc.setCheckpointDir(current)
        _LOCAL_ROOTS[app] = current
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint root for one written table."""
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return root.rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def cluster_conf(total_input_tb: float = 100.0) -> dict[str, str]:
    """Settings we recommend for the full-size deployment (applied by the job launcher;
    tests and the local benchmark use ``local_session``).

    AQE sizes shuffles at run time from a generous initial partition count, splits
    skewed join partitions, and turns joins against small change sets into broadcasts
    when runtime statistics allow.  Scan splits stay at 256 MB so a task's input fits
    comfortably in executor memory."""
    initial = max(2000, int(total_input_tb * 1024 * 1024 / 256 / 4))  # ~1 GB of shuffle per initial partition
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
