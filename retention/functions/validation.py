"""Type coercion (P1, P2) and row rules (V2-V7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ADDON_COLUMNS, BOOL_COLUMNS, DOUBLE_COLUMNS, ENUM_DOMAINS, INPUT_COLUMNS, INT_COLUMNS

TRUE_TEXT = ["yes", "true", "1"]
FALSE_TEXT = ["no", "false", "0"]


def parse_bool(c: Column) -> Column:
    """yes/true/1 -> true, no/false/0 -> false, anything else -> null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE_TEXT), F.lit(True)).when(s.isin(*FALSE_TEXT), F.lit(False))


def coerce_column(df: DataFrame, name: str) -> Column:
    """Typed version of one subscriber column; bad text becomes null, never an error."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if name in BOOL_COLUMNS or name == "churn":
        return (c if isinstance(dtype, T.BooleanType) else parse_bool(c)).alias(name)
    if name in DOUBLE_COLUMNS:
        if isinstance(dtype, T.StringType):
            return F.trim(c).try_cast("double").alias(name)
        return c.cast("double").alias(name)
    if name in INT_COLUMNS:
        if isinstance(dtype, T.StringType):
            # "12.0" is a valid tenure in text files; fractional months are not
            d = F.trim(c).try_cast("double")
            return F.when(d == F.floor(d), d.cast("int")).alias(name)
        return c.cast("int").alias(name)
    if name in ("created_at", "updated_at") and not isinstance(dtype, T.TimestampType):
        return F.to_timestamp(c).alias(name)
    return c.cast("string").alias(name)


def impute_total_charges() -> Column:
    """Missing total charges -> monthly x tenure."""
    return F.coalesce(F.col("total_charges"), F.col("monthly_charges") * F.col("tenure_months"))


# ---- row rules: (condition, code) pairs; a row breaks a rule when its condition is true --
def rule_checks() -> list[tuple[Column, str]]:
    """All rule checks in a fixed order (V4 nulls/domains, V2/V3 ranges, V5-V7)."""
    checks: list[tuple[Column, str]] = []
    for name in INPUT_COLUMNS:
        if name == "customer_id":
            continue  # optional on input
        checks.append((F.col(name).isNull(), f"missing_{name}"))
    for name, domain in ENUM_DOMAINS.items():
        checks.append((F.col(name).isNotNull() & ~F.col(name).isin(*domain), f"invalid_{name}"))
    mc, tc, ten = F.col("monthly_charges"), F.col("total_charges"), F.col("tenure_months")
    checks.append((mc <= 0, "monthly_charges_not_positive"))
    checks.append((tc < 0, "total_charges_negative"))
    checks.append((ten < 0, "tenure_months_negative"))
    # V5: total must reach 80 % of monthly x tenure for customers with tenure
    checks.append(((ten > 0) & (tc < mc * ten * F.lit(0.8)), "total_charges_inconsistent"))
    # V6: phone service and lines agree
    ph, ml = F.col("phone_service"), F.col("multiple_lines")
    checks.append((((~ph) & (ml != "No phone service")) | (ph & (ml == "No phone service")), "multiple_lines_inconsistent"))
    # V7: without internet, every add-on is "No internet service" or "No"
    addon_bad = F.lit(False)
    for a in ADDON_COLUMNS:
        addon_bad = addon_bad | ~F.col(a).isin("No internet service", "No")
    checks.append(((F.col("internet_service") == "No") & addon_bad, "internet_addons_inconsistent"))
    return checks


def rule_codes() -> list[Column]:
    """Each check as a code (string) when broken, else null."""
    return [F.when(cond, F.lit(code)) for cond, code in rule_checks()]


def error_codes() -> Column:
    """Array of the codes a row breaks (empty = valid)."""
    return F.array_compact(F.array(*rule_codes()))


def error_text() -> Column:
    """The broken rules' codes joined by ',' ('' = valid).  ``concat_ws`` skips the
    nulls of unbroken rules and stays inside whole-stage codegen (unlike the
    higher-order ``array_compact``)."""
    return F.concat_ws(",", *rule_codes())


def breaks_any_rule() -> Column:
    """True when at least one rule is broken (a null condition is not a break) - the
    cheap test for the valid path: no per-row array is built."""
    out = F.lit(False)
    for cond, _ in rule_checks():
        out = out | F.coalesce(cond, F.lit(False))
    return out
