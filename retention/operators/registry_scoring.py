"""Scoring by registry (T10, C1, C2): every row is scored by the version that its model serves now.

Rows carry the id of their model.  The registry names the current version of each model, and ids that
serve the same stored pipeline are scored together: one branch a pipeline, which filters the rows by id
(a predicate that reaches the scan, or prunes partitions of a table kept by model id).  A pipeline is loaded
once, by its path in the shared folder, and Spark ML sends its forest once to each executor.  Rows are
never shuffled, so a model with a third of all rows is spread like any other.

A plan grows with its branches, so ``score_fleet`` writes a fleet of any size in batches of pipelines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .cleaning import validate
from .model import current_models, load_model, register_run
from .scoring import SCORED_COLUMNS, _errors, _served, predict

NO_MODEL = "no_current_model"
BATCH = 32  # pipelines of one plan


@dataclass(frozen=True)
class Served:
    """A stored pipeline and the models it serves: pairs of model id and version."""

    path: str
    models: tuple[tuple[str, str | None], ...]


def serving(registry: DataFrame) -> list[Served]:
    """What is served now, from the registry's one current row a model.  A model whose latest passing
    entry has no path is retired."""
    rows = current_models(registry).filter("model_path IS NOT NULL AND model_id IS NOT NULL")
    by_path: dict[str, list] = {}
    for r in rows.select("model_path", "model_id", "model_version").orderBy("model_path", "model_id").collect():
        by_path.setdefault(r["model_path"], []).append((r["model_id"], r["model_version"]))
    return [Served(path, tuple(models)) for path, models in by_path.items()]


def retire(spark: SparkSession, path: str, model_ids: list[str], run_id: str, ts) -> str:
    """Take models out of service as run ``run_id``: entries without a path, later than those they end."""
    entries = spark.createDataFrame([(m, None, None, ts, True) for m in model_ids],
                                    "model_id string, model_path string, model_version string, ts timestamp, passed boolean")
    return register_run(entries, path, run_id)


def _branch(rows: DataFrame, one: Served, load, include_analysis: bool, t: Thresholds) -> DataFrame:
    own = rows.filter(F.col("model_id").isin(*[m for m, _ in one.models]))
    scored = predict(own, load(one.path), None)
    versions = [(m, v) for m, v in one.models if v is not None]
    if versions:
        named = F.create_map(*[F.lit(x) for pair in versions for x in pair])
        scored = scored.withColumn("model_version", F.coalesce(F.try_element_at(named, F.col("model_id")), "model_version"))
    return _served(scored, include_analysis, t, ("model_id",))


def score_by_registry(df: DataFrame, registry: DataFrame, include_analysis: bool = True, t: Thresholds = DEFAULT,
                      load=load_model, served: list[Served] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, errors) of rows that carry ``model_id``.  Errors are rows that break validation rules, and
    rows whose model is null, unknown or retired (``no_current_model``)."""
    served = serving(registry) if served is None else served
    ids = [m for s in served for m, _ in s.models]
    known = F.coalesce(F.col("model_id").isin(*ids), F.lit(False)) if ids else F.lit(False)
    ok, bad = validate(df.filter(known))
    unserved = _errors(df.filter(~known).withColumn("error", F.lit(NO_MODEL)), "model_id")
    branches = [_branch(ok, s, load, include_analysis, t) for s in served]
    empty = df.sparkSession.createDataFrame([], _schema())
    scored = reduce(DataFrame.unionByName, branches) if branches else empty
    return scored, _errors(bad, "model_id").unionByName(unserved)


def _schema() -> str:
    kinds = {"prediction": "boolean", "customer_id": "string", "risk_level": "string", "customer_segment": "string",
             "model_version": "string", "prediction_timestamp": "timestamp"}
    return "model_id string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SCORED_COLUMNS)


def score_fleet(df: DataFrame, registry: DataFrame, path: str, include_analysis: bool = True, t: Thresholds = DEFAULT,
                load=load_model, batch: int = BATCH) -> DataFrame:
    """The scored rows of a fleet of any size, written under ``path`` by batches of pipelines; returns the
    written table.  A repeated run replaces each batch as a whole.  Keep ``df`` partitioned by model id: a
    batch then reads its own models' rows only."""
    spark, served = df.sparkSession, serving(registry)
    for at in range(0, len(served), batch):
        some = served[at:at + batch]
        ids = [m for s in some for m, _ in s.models]
        scored, _ = score_by_registry(df.filter(F.col("model_id").isin(*ids)), registry, include_analysis, t, load, some)
        scored.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={at // batch}")
    if not served:
        return spark.createDataFrame([], _schema())
    return spark.read.parquet(path).drop("batch")
