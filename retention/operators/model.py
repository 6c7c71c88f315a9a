"""Model training, evaluation, persistence and promotion (T1-T10) on Spark ML.

One ``PipelineModel`` holds preprocessing and the forest, so training and serving use
the same feature layout.  The preprocessor is fitted on training rows only.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .evaluation import evaluate
from .selection import in_share

CATEGORICAL_FEATURES = [
    "gender", "multiple_lines", "internet_service", "online_security", "online_backup", "device_protection",
    "tech_support", "streaming_tv", "streaming_movies", "contract_type", "payment_method",
]
NUMERIC_FEATURES = [
    "senior_citizen", "partner", "dependents", "phone_service", "paperless_billing",
    "monthly_charges", "total_charges", "tenure_months",
]
MODEL_TYPE = "RandomForestClassifier"


def split_hash(id_col: str = "customer_id", seed: int = DEFAULT.seed) -> "F.Column":
    """First 8 hex digits of md5(id || seed): a per-row uniform draw, same in any engine."""
    return F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8)


def _cut(test_size: float) -> str:
    return format(int(test_size * 16**8), "08x")


def stratified_split(
    df: DataFrame, test_size: float = DEFAULT.test_size, seed: int = DEFAULT.seed, label: str = "churn",
    id_col: str = "customer_id", exact: bool = False,
) -> DataFrame:
    """Add ``is_test``.

    Default: a row is in the test set when its hash is below ``test_size`` of the hash
    range - independent per row, so each class gets the test share in expectation, with
    no shuffle.  ``exact=True``: in each class exactly round(test_size * n_class) rows by
    hash order; the cut of each class is found by passes over hash histograms, and the rows
    then only pass a comparison.  Rows of one id stay on one side (if they straddle the cut, in
    training), and rows without an id count as one id before all others."""
    h = split_hash(id_col, seed)
    if not exact:
        return df.withColumn("is_test", h < F.lit(_cut(test_size)))
    key = F.coalesce(F.concat(h, F.col(id_col).cast("string")), F.lit(""))
    return df.withColumn("is_test", in_share(df, key, label, test_size))


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """Balanced weights n / (2 * n_class) per label value (one row per class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.select(F.sum("n_class")).scalar()
    return counts.select(
        label, F.col("n_class").cast("bigint").alias("n_class"), (total / (F.lit(2.0) * F.col("n_class"))).alias("class_weight")
    )


def with_class_weight(df: DataFrame, label: str = "churn") -> DataFrame:
    """Attach ``class_weight``; the weight table has one row per class (<= 2), broadcast."""
    w = class_weights(df, label).select(label, "class_weight")
    return df.join(F.broadcast(w), label, "inner")


def build_preprocessor() -> list:
    """Numeric (incl. 0/1 flags) standardised, categoricals one-hot with the
    alphabetically first level dropped; assembled into ``features``."""
    idx_cols = [f"{c}_idx" for c in CATEGORICAL_FEATURES]
    ohe_cols = [f"{c}_ohe" for c in CATEGORICAL_FEATURES]
    return [
        StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=idx_cols, stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True),
        VectorAssembler(inputCols=[f"{c}_num" for c in NUMERIC_FEATURES], outputCol="numeric_raw"),
        StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["numeric_scaled", *ohe_cols], outputCol="features"),
    ]


def model_input(df: DataFrame, label: str | None = "churn") -> DataFrame:
    """Numeric copies of the feature columns (flags as 0/1) and a double label."""
    out = df.select(
        "*", *[F.coalesce(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"{c}_num") for c in NUMERIC_FEATURES]
    )
    if label and label in df.columns:
        out = out.withColumn("label", F.col(label).cast("double"))
    return out


def train_random_forest(train: DataFrame, t: Thresholds = DEFAULT, label: str = "churn") -> PipelineModel:
    """Fit preprocessing + balanced random forest on the training rows."""
    data = with_class_weight(
        train.filter(F.col(label).isNotNull()).dropna(subset=CATEGORICAL_FEATURES + NUMERIC_FEATURES), label
    )
    # every estimator in the pipeline scans its input: keep it materialised while fitting
    data = model_input(data, label).persist()
    try:
        rf = RandomForestClassifier(
            featuresCol="features", labelCol="label", weightCol="class_weight",
            numTrees=t.num_trees, maxDepth=t.max_depth, seed=t.seed,
            # speed only (same trees): more node statistics per pass, cached node ids
            maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
        )
        return Pipeline(stages=[*build_preprocessor(), rf]).fit(data)
    finally:
        data.unpersist()


def churn_probability(pred: DataFrame) -> DataFrame:
    """Flatten Spark ML output to ``probability_churn`` and boolean ``prediction``."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(F.col("probability"))
    return pred.withColumn("probability_churn", F.when(F.size(p) > 1, p[1]).otherwise(p[0])).withColumn(
        "prediction", F.col("prediction") == F.lit(1.0)
    )


def train_and_evaluate(df: DataFrame, t: Thresholds = DEFAULT, label: str = "churn"):
    """Split, fit on the training part, evaluate on the test part.

    Returns (model, metrics DataFrame with one row)."""
    split = stratified_split(df.filter(F.col(label).isNotNull()), t.test_size, t.seed, label).persist()
    scored = None
    try:
        train = split.filter(~F.col("is_test")).drop("is_test")
        test = split.filter(F.col("is_test")).drop("is_test")
        model = train_random_forest(train, t, label)
        scored = churn_probability(model.transform(model_input(test.dropna(subset=CATEGORICAL_FEATURES + NUMERIC_FEATURES), label)))
        # confusion counts and AUC both read the scored test rows: score them once
        scored = scored.select(label, "prediction", "probability_churn").persist()
        metrics = evaluate(scored, label, "prediction", "probability_churn")
        counts = split.agg(
            F.count_if(~F.col("is_test")).cast("bigint").alias("training_samples"),
            F.count_if(F.col("is_test")).cast("bigint").alias("test_samples"),
        )
        m = metrics.select("accuracy", "precision", "recall", "f1_score", "roc_auc").withColumn(
            "training_samples", counts.select("training_samples").scalar()
        ).withColumn("test_samples", counts.select("test_samples").scalar())
        row = m.first()  # the one metrics row, so that nothing stays persisted behind it
        return model, df.sparkSession.createDataFrame([row], m.schema)
    finally:
        split.unpersist()
        if scored is not None:
            scored.unpersist()


def feature_names(model: PipelineModel) -> list[str]:
    """Slot names of the assembled feature vector (numeric first, then one-hot levels)."""
    names = list(NUMERIC_FEATURES)
    indexer = model.stages[0]
    for col, labels in zip(CATEGORICAL_FEATURES, indexer.labelsArray):
        # alphabetDesc order; dropLast removes the final (alphabetically first) level
        names.extend(f"{col}_{lv}" for lv in list(labels)[:-1])
    return names


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importance per feature slot (one row per slot; size = number of features)."""
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    names = feature_names(model)
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def model_info(spark: SparkSession, model: PipelineModel, metrics: DataFrame | None = None,
               version: str = DEFAULT.model_version, trained_at: _dt.datetime | None = None) -> DataFrame:
    """One registry row describing a fitted model."""
    rf = model.stages[-1]
    params = {p.name: str(v) for p, v in rf.extractParamMap().items() if p.name in ("numTrees", "maxDepth", "seed", "weightCol")}
    ts = trained_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    info = spark.createDataFrame(
        [(version, MODEL_TYPE, len(feature_names(model)), params, ts)],
        "model_version string, model_type string, n_features int, parameters map<string,string>, trained_at timestamp",
    )
    if metrics is not None:
        for c in ("training_samples", "test_samples"):
            if c in metrics.columns:
                info = info.withColumn(c, metrics.select(c).scalar())
    return info


def save_model(model: PipelineModel, path: str) -> str:
    """One artefact directory (preprocessing + forest)."""
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """T8."""
    return PipelineModel.load(path)


def validate_metrics(metrics: DataFrame, t: Thresholds = DEFAULT, groups: list[str] | None = None) -> DataFrame:
    """One row per (group, metric): value, minimum, passed (value >= minimum).

    The threshold table has one row per checked metric (3, or 4 with an F1 minimum)."""
    groups = list(groups or [])
    mins = [("accuracy", t.min_accuracy), ("precision", t.min_precision), ("recall", t.min_recall)]
    if t.min_f1_score is not None:
        mins.append(("f1_score", t.min_f1_score))
    spark = metrics.sparkSession
    th = F.broadcast(spark.createDataFrame(mins, "metric string, threshold double"))
    long = metrics.select(
        *groups,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, _ in mins])),
    )
    return long.join(th, "metric").select(
        *groups, "metric", "value", "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed")
    )


def validation_summary(validation: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """T9 overall: passed when every checked metric passed; failing metrics as details."""
    groups = list(groups or [])
    return validation.groupBy(*groups).agg(
        F.bool_and("passed").alias("passed"),
        F.map_from_entries(
            F.collect_list(F.when(~F.col("passed"), F.struct("metric", F.col("value").cast("string"))))
        ).alias("details"),
    )


class ModelValidationError(ValueError):
    pass


def require_valid(summary: DataFrame) -> DataFrame:
    """T9 gate: raise when any group failed validation (deployment is skipped)."""
    failed = summary.filter(~F.col("passed")).limit(1).collect()
    if failed:
        raise ModelValidationError("Model validation failed - metrics below threshold")
    return summary


def promote(spark: SparkSession, registry_path: str | None, entry: DataFrame, out_path: str) -> DataFrame:
    """Append a model entry (model_path, model_version, ts, passed, metrics...) to
    the registry as a new snapshot; returns the written registry.  Failed models are recorded
    too, with ``passed`` false; ``current_model`` never names one."""
    reg = entry
    if registry_path:
        reg = spark.read.parquet(registry_path).unionByName(entry, allowMissingColumns=True)
    reg.write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)


def current_model(registry: DataFrame) -> DataFrame:
    """The latest passing version (max_by is a partial aggregate)."""
    return registry.filter(F.col("passed")).agg(
        F.max_by("model_path", "ts").alias("model_path"),
        F.max_by("model_version", "ts").alias("model_version"),
        F.max("ts").alias("ts"),
    )


REGISTRY_SCHEMA = ("model_id string, model_path string, model_version string, ts timestamp, passed boolean, accuracy double, "
                   "precision double, recall double, f1_score double, run_id string")


def register_run(entries: DataFrame, path: str, run_id: str) -> str:
    """T10 by run: store a run's model entries as its own partition of the registry; a repeated run
    replaces its entries, and no other run's are read or written."""
    from ..sources.run_log import append_run

    kept = [c.split()[0] for c in REGISTRY_SCHEMA.split(", ") if c.split()[0] in entries.columns and c.split()[0] != "run_id"]
    return append_run(entries.select(*kept), path, run_id)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All registered entries; empty before the first run."""
    from ..sources.run_log import read_runs

    return read_runs(spark, path, REGISTRY_SCHEMA)


def current_models(registry: DataFrame) -> DataFrame:
    """The latest passing version of every model (max_by is a partial aggregate); ties go to the
    later run, then version."""
    order = F.struct("ts", "run_id", "model_version")
    return registry.filter("passed").groupBy("model_id").agg(
        F.max_by("model_path", order).alias("model_path"), F.max_by("model_version", order).alias("model_version"), F.max("ts").alias("ts"))
