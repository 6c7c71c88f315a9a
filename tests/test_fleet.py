"""Rank selection, registry scoring, the metric log as a stream, quantile sketches."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from retention import fixtures
from retention.operators import model, monitoring, quantile_sketch, registry_scoring, selection
from retention.schema import METRICS_SCHEMA
from retention.session import scratch_path
from retention.streaming import metric_monitor
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text

DRAW = random.Random(3)
NUMBERS = {
    "one": [1.0], "two": [1.0, 2.0], "ties": [3.0, 1.0, 2.0, 2.0], "hot": [5.0] * 900 + [float(i) for i in range(300)],
    "special": [float("inf"), -float("inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308],
    "normal": [DRAW.gauss(0, 1e6) for _ in range(2001)], "dense": [1 + i * 2**-52 for i in range(1500)],
    "wide": [math.exp(DRAW.uniform(-700, 700)) * DRAW.choice([1, -1]) for _ in range(2000)],
}


def quantile(values, share):
    ordered = sorted(values)
    place = (len(ordered) - 1) * share
    low, high, part = ordered[int(place)], ordered[math.ceil(place)], place - int(place)
    return low if part == 0 or low == high else low * (1 - part) + high * part


@pytest.mark.parametrize("name", sorted(NUMBERS))
def test_exact_quantiles(spark, name):
    df = spark.createDataFrame([(v,) for v in [*NUMBERS[name], None]], "v double")
    shares = [0.5, 0.1, 0.99, 0.0, 1.0]
    assert selection.exact_quantiles(df, "v", shares) == [quantile(NUMBERS[name], s) for s in shares]


def test_quantiles_of_nothing_and_nan(spark):
    assert selection.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5, 0.9]) == [None, None]
    found = selection.exact_quantiles(spark.createDataFrame([(float("nan"),), (2.0,), (1.0,)], "v double"), "v", [0.5, 1.0])
    assert found[0] == 2.0 and math.isnan(found[1])


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_exact_split_takes_the_first_by_hash(spark, share):
    rows = [(f"c{i}", [True, False, None][i % 3 if i % 7 else 0]) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_id string, churn boolean")
    out = model.stratified_split(df, share, exact=True)
    assert out.columns == ["customer_id", "churn", "is_test"]
    keyed = out.select("churn", "is_test", F.concat(model.split_hash(), "customer_id").alias("k")).collect()
    for label in (True, False, None):
        own = sorted((r["k"], r["is_test"]) for r in keyed if r["churn"] is label)
        cut = math.floor(len(own) * share + 0.5)
        assert [t for _, t in own] == [True] * cut + [False] * (len(own) - cut)


def test_exact_split_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([("a", True)] * 300 + [(None, True)] * 50 + [(f"c{i}", True) for i in range(150)], "customer_id string, churn boolean")
    out = model.stratified_split(df, 0.4, exact=True)
    sides = out.groupBy("customer_id").agg(F.count_distinct("is_test").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert out.filter("is_test").count() <= 200
    assert model.stratified_split(df.limit(0), exact=True).count() == 0


def test_split_and_median_do_not_shuffle_rows(spark):
    df = fixtures.clean_subscribers(spark, SF_SMALL).filter("churn IS NOT NULL")
    assert "Exchange" not in plan_text(model.stratified_split(df, exact=True))


# -- registry scoring --------------------------------------------------------------------------


def _pipeline(spark, statement):
    fitted = Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {statement} FROM __THIS__")]).fit(spark.range(1))
    return model.save_model(fitted, scratch_path(spark, "bare"))


def _entries(spark, rows):
    return spark.createDataFrame(rows, "model_id string, model_path string, model_version string, ts timestamp, passed boolean")


def test_rows_are_scored_by_what_their_model_serves(spark):
    low, high = (_pipeline(spark, f"{p}D AS probability_churn, {p} > 0.5 AS prediction") for p in (0.25, 0.75))
    day = [dt.datetime(2024, 1, n) for n in range(1, 5)]
    path = scratch_path(spark, "registry")
    model.register_run(_entries(spark, [("a", low, "1", day[0], True), ("b", low, None, day[0], True), ("c", low, "1", day[0], True)]), path, "r1")
    model.register_run(_entries(spark, [("a", high, "2", day[1], True), ("b", high, "2", day[1], False)]), path, "r2")
    registry_scoring.retire(spark, path, ["c"], "r3", day[2])
    registry = model.read_registry(spark, path)
    assert [(s.path, s.models) for s in registry_scoring.serving(registry)] == sorted([(high, (("a", "2"),)), (low, (("b", None),))])
    subs = fixtures.clean_subscribers(spark, SF_SMALL).limit(60).withColumn("confidence", F.lit("clash")).drop("confidence")
    ids = F.array(*[F.lit(x) for x in ("a", "b", "c", "never", None)])
    rows = subs.withColumn("model_id", F.get(ids, F.pmod(F.xxhash64("customer_id"), F.lit(5)).cast("int"))).persist()
    loads = []

    def load(path):
        loads.append(path)
        return model.load_model(path)

    scored, errors = registry_scoring.score_by_registry(rows, registry, load=load)
    got = scored.select("model_id", "probability_churn", "model_version", "confidence").distinct().collect()
    assert {tuple(r) for r in got} == {("a", 0.75, "2", 0.8), ("b", 0.25, "unknown", 0.8)}
    assert sorted(loads) == sorted([low, high])
    unserved = rows.filter("model_id IS NULL OR model_id IN ('c', 'never')").count()
    assert errors.filter(f"error = '{registry_scoring.NO_MODEL}'").count() == unserved
    assert scored.count() + errors.count() == rows.count()
    assert "Exchange" not in plan_text(scored)
    fleet = registry_scoring.score_fleet(rows, registry, scratch_path(spark, "fleet"), batch=1)
    assert fleet.columns == scored.columns and fleet.count() == scored.count()
    rows.unpersist()


def test_nothing_served(spark):
    rows = fixtures.clean_subscribers(spark, SF_SMALL).limit(3).withColumn("model_id", F.lit("a"))
    registry = _entries(spark, []).withColumn("run_id", F.lit("r"))
    scored, errors = registry_scoring.score_by_registry(rows, registry)
    assert scored.count() == 0 and errors.count() == 3
    assert registry_scoring.score_fleet(rows, registry, scratch_path(spark, "none")).columns == scored.columns


# -- the metric log as a stream --------------------------------------------------------------


def _log(spark, rows):
    full = [(m, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), a, a, a, a, "1", r) for m, d, r, a in rows]
    return spark.createDataFrame(full, METRICS_SCHEMA)


def _deliver(spark, parts, **options):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    for part in parts:
        _log(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        metric_monitor.start_metric_monitor(spark, inbox, out, state, **options).awaitTermination()
    return out


def test_streamed_degradation_equals_batch(spark):
    draw = random.Random(5)
    runs = [(m, d, f"{m}-{d}", round(draw.uniform(0.4, 0.95), 3)) for m, n in (("big", 40), ("few", 4), ("mid", 11)) for d in range(n)]
    runs += [("gaps", d, f"gaps-{d}", a) for d, a in enumerate([0.9, None, 0.9, 0.0, 0.9, 0.5, None, 0.5, 0.4, 0.4])]
    draw.shuffle(runs)
    wrong = [(m, d, r, 0.01) for m, d, r, _ in runs[:20]]
    out = _deliver(spark, [wrong + runs[20:35], runs[:20] + runs[10:30], runs[35:], runs[40:50]])
    want = monitoring.performance_degradation(_log(spark, runs))
    got = metric_monitor.latest_degradation(spark, out)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_alerts_arise_with_the_runs(spark):
    good = [("m", d, f"r{d}", 0.9) for d in range(10)]
    bad = [("m", d, f"r{d}", 0.5) for d in range(10, 15)]
    out = _deliver(spark, [good, bad])
    raised = metric_monitor.raised_alerts(spark, out).select("epoch", "model_id", "type", "severity").collect()
    assert [tuple(r) for r in raised] == [(1, "m", "MODEL_DEGRADATION", "CRITICAL")]


def test_rows_that_are_no_runs(spark):
    out = _deliver(spark, [[(None, 1, "x", 0.5), ("m", 1, None, 0.5)] + [("m", d, f"r{d}", 0.9) for d in range(5)]])
    assert [r["data_points"] for r in metric_monitor.latest_degradation(spark, out).collect()] == [5]


# -- quantile sketches ----------------------------------------------------------------------------


def test_merged_sketches_hold_their_rank_error(spark):
    df = spark.range(60_000).select((F.rand(4) * F.rand(5)).alias("p"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("day")).persist()
    path = scratch_path(spark, "sketches")
    for day in [*range(5), 2]:  # a repeated day replaces its own
        quantile_sketch.store_day(df.filter(F.col("day") == day), path, f"2024-01-0{day + 1}", "p", ["g"])
    stored = quantile_sketch.read_days(spark, path, "g long")
    whole = quantile_sketch.merged(stored)
    for share in (0.05, 0.5, 0.95):
        row = whole.select("n", quantile_sketch.quantile(share).alias("q")).first()
        assert row["n"] == 60_000
        assert abs(df.filter(F.col("p") <= row["q"]).count() / 60_000 - share) <= quantile_sketch.RANK_ERROR
    span = quantile_sketch.merged(quantile_sketch.read_days(spark, path, "g long", "2024-01-02", "2024-01-03"), ["g"])
    assert {r["n"] for r in span.collect()} == {8_000}
    df.unpersist()


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "probability_churn double")
    assert quantile_sketch.sketches(df).count() == 0
    assert quantile_sketch.merged(quantile_sketch.sketches(df)).count() == 0
    assert quantile_sketch.read_days(spark, scratch_path(spark, "no_days")).count() == 0
