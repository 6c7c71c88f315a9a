"""Hot keys: one key / value / model holds a third of all rows.  Results are checked
against brute force computed in plain Python on the same small fixture."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from retention.operators import analytics, evaluation, monitoring, ordered, tables
from retention.schema import METRICS_SCHEMA


def _values(n=3000, seed=7):
    rnd = random.Random(seed)
    hot = [42.0] * (n // 3)
    rest = [round(rnd.uniform(0, 100), 2) for _ in range(n - len(hot))]
    vals = hot + rest
    rnd.shuffle(vals)
    return vals


def _ks_brute(a, b):
    pts = sorted(set(a) | set(b))
    sa, sb = sorted(a), sorted(b)
    import bisect

    return max(abs(bisect.bisect_right(sa, x) / len(sa) - bisect.bisect_right(sb, x) / len(sb)) for x in pts)


def test_ks_with_hot_value(spark):
    a = _values(seed=1)
    b = [v + (5.0 if v != 42.0 else 0.0) for v in _values(seed=2)]
    da = spark.createDataFrame([(v,) for v in a], "x double").repartition(7)
    db = spark.createDataFrame([(v,) for v in b], "x double").repartition(5)
    got = monitoring.ks_two_sample(da, db, ["x"]).first().ks_statistic
    assert got == pytest.approx(_ks_brute(a, b), abs=1e-12)


def test_median_with_hot_value(spark):
    vals = _values(3001)
    df = spark.createDataFrame([(v,) for v in vals], "p double").repartition(6)
    assert ordered.exact_median(df, "p").first().median == pytest.approx(statistics.median(vals))


def test_auc_with_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.random() < 0.3, 0.5 if i % 3 == 0 else round(rnd.random(), 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "churn boolean, probability_churn double").repartition(6)
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(brute, abs=1e-12)


def test_upsert_hot_key_keeps_latest(spark):
    versions = [("HOT", float(i), i) for i in range(3000)]
    others = [(f"K{i}", float(i), i) for i in range(6000)]
    changes = spark.createDataFrame(versions + others, "customer_id string, v double, seq int").repartition(8)
    base = spark.createDataFrame([("HOT", -1.0), ("OLD", -2.0)], "customer_id string, v double")
    out = {r.customer_id: r.v for r in tables.upsert(base, changes, "seq").collect()}
    assert out["HOT"] == 2999.0 and out["OLD"] == -2.0 and len(out) == 6002


def test_hot_model_in_metric_log(spark):
    t0 = dt.datetime(2020, 1, 1)
    rows = [("hot", t0 + dt.timedelta(hours=i), 0.9 if i < 2990 else 0.5, 0.9, 0.9, 0.9, "1", f"h{i:05d}")
            for i in range(3000)]
    rows += [(f"m{k}", t0 + dt.timedelta(days=i), 0.8, 0.8, 0.8, 0.8, "1", f"m{k}-{i:03d}") for k in range(6) for i in range(20)]
    log = spark.createDataFrame(rows, METRICS_SCHEMA).repartition(8)
    out = {r.model_id: r for r in monitoring.performance_degradation(log).collect()}
    hot = out["hot"]
    assert hot.data_points == 3000 and hot.window_size == 5
    # baseline = the 10 runs before the newest 5: five at 0.9, five at 0.5
    assert hot.recent_accuracy == pytest.approx(0.5) and hot.baseline_accuracy == pytest.approx(0.7)
    assert hot.severity == "CRITICAL"
    assert out["m0"].severity == "NONE"


def test_distribution_hot_value(spark):
    vals = ["Low"] * 1000 + ["High"] * 1500 + ["Medium"] * 500
    df = spark.createDataFrame([(v,) for v in vals], "risk_level string").repartition(8)
    out = [(r.value, r["count"], r.percent) for r in analytics.distribution(df, "risk_level").collect()]
    assert out == [("High", 1500, 50.0), ("Low", 1000, 100.0 / 3), ("Medium", 500, 100.0 / 6)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_running_totals_over_many_keys(spark, reuse):
    """Ranges are the same on every branch, whatever columns it carries and whether exchanges are reused."""
    n = 400_000
    wide = spark.range(n).select(
        F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("h"), F.repeat(F.col("id").cast("string"), 5).alias("payload"))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        for key in ("k", "h"):
            got = ordered.sequence_numbers(wide, key).agg(
                F.count("payload"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
            assert tuple(got) == (n, n, 1, n)
        base = spark.range(1000).select(F.format_string("CUST-%04d", F.col("id") + 1).alias("customer_id"), F.lit("x").alias("payload"), F.lit(0).alias("v"))
        assert ordered.exact_median(wide.select((F.col("k") % 1_000_003).cast("double").alias("p")).distinct(), "p").first().median is not None
        assert ordered.sequence_numbers(base, "customer_id").filter(
            F.col("seq") != F.substring("customer_id", 6, 9).cast("long")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_shared_folder_is_required_off_local_mode():
    from types import SimpleNamespace

    from retention.session import checkpoint_root

    context = SimpleNamespace(getCheckpointDir=lambda: None, applicationId="app-off-local", master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session)
