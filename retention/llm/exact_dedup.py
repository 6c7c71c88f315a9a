"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition is a leaf.  Its texts become digests, and its digests one run: a row per distinct
digest with the number of rows, the identifier that stays, and the identity of that row.  Partition
numbers are read in base ``fan_in`` = 2^k: in every round the runs whose numbers differ in the lowest k
bits only (the partners of k binomial rounds) are exchanged by (merged run, digest), sorted by digest
and merged in one multiway pass (a sort aggregate).  The merged run is numbered by the bits left, so
log(leaves) rounds end in one run, which is dealt by digest over all executors: no run, level or group
of copies is ever held by one task, and a digest sends at most one row from each partner.

Verified: a run is keyed by the SHA-256 and by an independent 64-bit hash with the length of the
normalised text; only rows equal in all of them are merged, at every level, and each merge retains the
smallest identifier (most code points first, then smallest id) with the row it belongs to.

The answer goes back down the same tree.  A merged row remembers in a bit mask which of its partners
had the digest, so its result is sent to exactly those, level by level, and at the leaf it meets only
that leaf's rows: a group of copies of any size never meets in one place.

Defined results: null texts count as empty, and all empty texts are one group; null ids come after all
others; of rows equal in id and length, the first in the order of the stored ledger stays, exactly one a
group; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WHITE = " \t\n\x0b\x0c\r"  # fixed by the contract
FAN_IN = 16  # partners merged in one pass: four binomial rounds


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chars, sha, proof) of every row, and the row as ``doc``."""
    plain = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("chars"),
                        normalised(F.col(text_col)).alias("plain"))
    return plain.select("doc", "id", "chars", F.unhex(F.sha2("plain", 256)).alias("sha"),
                        F.xxhash64(F.lit(29), "plain", F.length("plain")).alias("proof"))


def first_of() -> Column:
    """The row that stays sorts first: most code points, smallest id (null last), first row."""
    return F.struct((-F.col("chars")).alias("order"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: the runs of ``fan_in`` partners as one, with a mask of the partners that had the digest."""
    return runs.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "sha", "proof").agg(
        F.min("first").alias("first"), F.sum("copies").alias("copies"),
        F.bit_or(F.expr(f"shiftleft(1L, run % {fan_in})")).alias("had"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: its id under ``id_col``, keep_id, group_size, kept, text_sha256."""
    if not 2 <= fan_in <= 32:
        raise ValueError("fan_in must be 2 to 32")
    # the rows' own order and partition become data here, so that a lost executor can't change them
    rows = materialize(
        digested(docs, id_col, text_col).drop("doc")
        .withColumn("run", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    last = rows.agg(F.max("run")).first()[0] or 0
    levels = [rows.select("run", "sha", "proof", first_of().alias("first"), F.lit(1).cast("long").alias("copies"))]
    while True:
        levels.append(materialize(merged(levels[-1], fan_in), f"exact-runs-{len(levels)}"))
        last //= fan_in
        if last == 0:
            break
    # down again: only digests with copies, and only to the partners that had them
    answer = levels[-1].filter("copies > 1").select("run", "sha", "proof", F.col("first").alias("keep"), F.col("copies").alias("size"), "had")
    for level in [*levels[-2:0:-1], None]:
        below = answer.select(
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(fan_in - 1)), lambda k: F.getbit("had", k) == 1)).alias("partner"), "*").select(
            (F.col("run") * fan_in + F.col("partner")).cast("int").alias("run"), "sha", "proof", "keep", "size")
        answer = below if level is None else below.join(level.select("run", "sha", "proof", "had"), ["run", "sha", "proof"])
    answer = materialize(answer, "exact-answer")
    done = rows.join(answer, ["run", "sha", "proof"], "left")
    return done.select(
        F.col("id").alias(id_col), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that stays."""
    kept = ledger(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", fan_in).filter("kept").select(
        F.unhex("text_sha256").alias("sha"), F.col("id").alias("keep"))
    same = digested(docs, id_col, text_col).join(kept, "sha").filter(F.col("id").eqNullSafe(F.col("keep")))
    # rows that share the id too: one of the longest; a row number of 1 is found before the shuffle
    order = Window.partitionBy("sha").orderBy(F.desc("chars"), F.xxhash64(F.col("doc")[text_col]))
    return same.withColumn("place", F.row_number().over(order)).filter("place = 1").select("doc.*")
