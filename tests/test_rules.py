"""Hand-worked rule values (both sides of each threshold), nulls and validation."""

import pytest
from pyspark.sql import functions as F

from retention.functions import rules
from retention.operators import cleaning, features
from retention.schema import SUBSCRIBER_SCHEMA

EX1 = dict(
    customer_id="CUST-001", gender="Female", senior_citizen=False, partner=True, dependents=False,
    phone_service=True, multiple_lines="No", internet_service="Fiber optic", online_security="No",
    online_backup="Yes", device_protection="No", tech_support="No", streaming_tv="Yes", streaming_movies="No",
    contract_type="Month-to-month", paperless_billing=True, payment_method="Electronic check",
    monthly_charges=70.35, total_charges=1510.45, tenure_months=24, churn=None,
)
EX2 = dict(
    customer_id="CUST-002", gender="Male", senior_citizen=True, partner=False, dependents=True,
    phone_service=False, multiple_lines="No", internet_service="DSL", online_security="Yes",
    online_backup="No", device_protection="Yes", tech_support="Yes", streaming_tv="No", streaming_movies="No",
    contract_type="Two year", paperless_billing=False, payment_method="Bank transfer (automatic)",
    monthly_charges=45.99, total_charges=1200.50, tenure_months=48, churn=None,
)


def frame(spark, *rows):
    cols = [f.name for f in SUBSCRIBER_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], SUBSCRIBER_SCHEMA)


def test_worked_examples(spark):
    out = features.add_rule_features(frame(spark, EX1, EX2)).orderBy("customer_id").collect()
    a, b = out
    assert (a.is_high_value, b.is_high_value) == (True, False)
    assert (a.has_premium_services, b.has_premium_services) == (True, True)
    assert (a.service_count, b.service_count) == (4, 4)
    assert (a.services_count_raw, b.services_count_raw) == (4, 4)
    assert (a.risk_score, b.risk_score) == (55.0, 40.0)
    assert a.lifetime_value == pytest.approx(5065.2)
    assert b.lifetime_value == pytest.approx(4415.04)
    assert (a.segment, b.segment) == ("high_value_low_risk", "low_value_low_risk")
    assert round(a.avg_monthly_charge, 4) == 60.4180 and round(b.avg_monthly_charge, 4) == 24.5


def test_example_two_is_quarantined(spark):
    ok, bad = cleaning.validate(frame(spark, EX1, EX2))
    assert [r.customer_id for r in ok.collect()] == ["CUST-001"]
    (row,) = bad.collect()
    assert row.customer_id == "CUST-002"
    assert row.error.split(",") == ["total_charges_inconsistent", "multiple_lines_inconsistent"]


@pytest.mark.parametrize(
    "change,expected",
    [
        ({"contract_type": "One year"}, 55 - 15),
        ({"contract_type": "Two year"}, 55 - 30),
        ({"payment_method": "Mailed check"}, 75),
        ({"payment_method": "Credit card (automatic)"}, 65),
        ({"tenure_months": 11, "total_charges": 800.0}, 55 - 5 + 20),
        ({"tenure_months": 12, "total_charges": 900.0}, 55 - 5 + 10),
        ({"tenure_months": 36, "total_charges": 3000.0}, 55 - 5),
        ({"monthly_charges": 60.0}, 50),
        ({"monthly_charges": 80.0}, 55),
        ({"monthly_charges": 80.01}, 60),
        ({"monthly_charges": 100.01, "total_charges": 3000.0}, 65),
        ({"senior_citizen": True}, 60),
        ({"partner": False}, 65),
        ({"online_security": "Yes", "device_protection": "Yes", "tech_support": "Yes"}, 55 - 10),
    ],
)
def test_risk_score_thresholds(spark, change, expected):
    row = dict(EX1, **change)
    (r,) = features.add_rule_features(frame(spark, row)).select("risk_score").collect()
    assert r.risk_score == expected


def test_risk_score_capped(spark):
    worst = dict(EX1, contract_type="Month-to-month", payment_method="Mailed check", tenure_months=1,
                 total_charges=120.0, monthly_charges=120.0, senior_citizen=True, partner=False, dependents=False,
                 phone_service=False, multiple_lines="No phone service", internet_service="No",
                 online_security="No internet service", online_backup="No internet service",
                 device_protection="No internet service", tech_support="No internet service",
                 streaming_tv="No internet service", streaming_movies="No internet service")
    (r,) = features.add_rule_features(frame(spark, worst)).select("risk_score", "service_count").collect()
    assert r.service_count == 0 and r.risk_score == 100.0


def test_null_label_is_active(spark):
    rows = [dict(EX1, customer_id="A", churn=None), dict(EX1, customer_id="B", churn=True),
            dict(EX1, customer_id="C", churn=False, tenure_months=3, total_charges=300.0)]
    out = {r.customer_id: r for r in features.add_rule_features(frame(spark, *rows)).collect()}
    assert out["A"].segment == "high_value_low_risk"
    assert out["B"].segment == "churned"
    assert out["B"].lifetime_value == pytest.approx(70.35 * 24)
    assert out["C"].segment == "new_customers"
    df = frame(spark, *rows)
    assert {r.customer_id for r in cleaning.find_churned(df).collect()} == {"B"}
    assert {r.customer_id for r in cleaning.find_active(df).collect()} == {"C"}


@pytest.mark.parametrize(
    "p,prob_level,conf_level,display",
    [(0.29, "low", "Low", "Low"), (0.3, "medium", "Low", "Low"), (0.5, "high", "Low", "Medium"),
     (0.66, "high", "Medium", "High"), (0.76, "critical", "High", "High"), (0.8, "critical", "High", "High"),
     (0.86, "critical", "Critical", "Critical")],
)
def test_risk_level_scales(spark, p, prob_level, conf_level, display):
    df = spark.createDataFrame([(p,)], "probability_churn double")
    (r,) = df.select(
        rules.risk_level("probability_churn", "probability").alias("a"),
        rules.risk_level("probability_churn", "confidence").alias("b"),
        rules.risk_level("probability_churn", "display").alias("c"),
        rules.confidence("probability_churn").alias("conf"),
    ).collect()
    assert (r.a, r.b, r.c) == (prob_level, conf_level, display)
    assert r.conf == pytest.approx(abs(2 * p - 1))


def test_recommendations(spark):
    df = spark.createDataFrame(
        [(True, "Critical", 0.9, "high_value_high_risk"), (True, "Medium", 0.55, "low_value_high_risk"),
         (False, "Low", 0.1, "low_value_low_risk")],
        "prediction boolean, risk_level string, probability_churn double, customer_segment string",
    )
    recs = [r[0] for r in df.select(rules.recommendations()).collect()]
    assert len(recs[0]) == 3 + 1 + 1 + 3
    assert recs[0][3] == rules.PRIORITY_ACTION and recs[0][4] == rules.VIP_ACTION
    assert recs[1] == rules.GENERAL_ACTIONS
    assert recs[2] == rules.LOYALTY_ACTIONS


def test_coerce_text(spark):
    raw = spark.createDataFrame(
        [("Yes", "12.5", "7", "No"), ("false", "abc", "7.5", "maybe"), ("1", None, " 3 ", "true")],
        "partner string, monthly_charges string, tenure_months string, churn string",
    )
    out = cleaning.coerce_types(raw).collect()
    assert [r.partner for r in out] == [True, False, True]
    assert [r.monthly_charges for r in out] == [12.5, None, None]
    assert [r.tenure_months for r in out] == [7, None, 3]
    assert [r.churn for r in out] == [False, None, True]


def test_impute_and_encoding(spark):
    df = cleaning.impute(frame(spark, dict(EX1, total_charges=None)))
    assert df.first().total_charges == pytest.approx(70.35 * 24)
    enc = features.encode_features(frame(spark, EX1)).first().asDict()
    assert len(enc) == 32
    assert enc["internet_service_fiber_optic"] == 1 and enc["internet_service_yes"] == 0
    assert enc["payment_method_electronic_check"] == 1 and enc["gender_male"] == 0


def test_record_timestamps_roundtrip(spark):
    import datetime as dt

    df = frame(spark, EX1).withColumn("created_at", F.lit(dt.datetime(2024, 3, 5, 7, 8, 9, 123456))).withColumn(
        "updated_at", F.lit(None).cast("timestamp")
    )
    text = cleaning.to_record(df).first()
    assert text.created_at == "2024-03-05T07:08:09.123456" and text.updated_at is None
    back = cleaning.from_record(cleaning.to_record(df)).first()
    assert back.created_at == dt.datetime(2024, 3, 5, 7, 8, 9, 123456) and back.updated_at is None
    assert back.monthly_charges == 70.35 and back.partner is True
