"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one long whose
bit i says that rule i failed.  A policy version is a mask over those bits, so a new policy or an
ablation needs no text: ``apply_policy`` is one bitwise AND, and ``ablations`` groups the ledger by
its masked bits (at most 2^rules rows after partial aggregation) and reads every leave-one-out
result from that histogram.

Repeated 5-word windows are found inside the document: window hashes (64 bits) are compared as a
set first, and only documents that repeat one sort them with their positions.  Map-only, JVM only.

Defined results: null and empty texts have zero measurements and fail ``few_words``; repeated rows
are judged alike; only the text column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

WINDOW = 5  # fixed by the contract


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: str  # SQL over the measurements


# base rules (bits 0, 1) are fixed by the contract; the rest are the method's own
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
    Rule(6, "few_letter_words", "2 * n_letter_words < n_words"),
    Rule(7, "shouting", "10 * n_exclamations > 3 * n_words"),
)
MASK = {r.name: 1 << r.bit for r in RULES}
BASE_MASK = MASK["few_words"] | MASK["repeated_words"]
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | MASK["symbols"] | MASK["duplicate_lines"],
    "v2": sum(MASK.values()),
}
CURRENT = "v2"


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice: positions sorted by hash, neighbours with
    an equal hash marked, and the union of their intervals measured by a fold."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        hit = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                       | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    return F.aggregate(
        let(pairs, marked),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda z, i: F.struct((i + WINDOW).alias("end"), (z["n"] + i + WINDOW - F.greatest(i, z["end"])).alias("n")),
        lambda z: z["n"])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the measurements (longs) and ``failed_bits``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, windows = F.col("__words"), F.col("__windows")
    hashed = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    measured = (
        docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("__windows", hashed)
        .withColumn("__lines", let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u"))))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_lines", F.col("__lines")["n"].cast("long"))
        .withColumn("n_dup_lines", (F.col("__lines")["n"] - F.col("__lines")["u"]).cast("long"))
        .withColumn("n_repeat_words", F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0)
                    .otherwise(_repeat_words(windows)).cast("long"))
        .withColumn("n_letter_words", F.regexp_count(text, F.lit(rf"\p{{L}}[^{SPACE}]*")).cast("long"))
        .withColumn("n_exclamations", F.regexp_count(text, F.lit("!!")).cast("long"))
    )
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return measured.withColumn("failed_bits", bits).drop("__words", "__windows", "__lines")


def apply_policy(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under one policy version."""
    failed = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask)) != 0
    return ledger_rows.withColumn("base_failed", failed(BASE_MASK)).withColumn(
        "kept", ~failed(BASE_MASK) & ~failed(POLICIES[policy]))


def ablations(ledger_rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents failing the rule, failing only it, and kept without it."""
    policies = policies or POLICIES
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p, m in policies.items() for r in RULES if m >> r.bit & 1])
    rows = patterns.select("n", "failed_bits", F.inline(cases)).withColumn("hit", F.col("failed_bits").bitwiseAND(F.col("mask")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("policy", "rule").agg(
        total(F.col("hit").bitwiseAND(F.col("bit")) != 0)("failing"),
        total(F.col("hit") == F.col("bit"))("failing_only"),
        total(F.col("hit") == 0)("kept"),
        total(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"))
