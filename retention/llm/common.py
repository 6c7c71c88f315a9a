"""Helpers shared by the text operators: word pattern, scratch tables, expression binding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retention.session import checkpoint_root

# fixed by the data contract: white space is exactly these ASCII characters
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: later jobs start from
    that table, so a lost executor never replays what came before it, and the shuffle files of the
    write are removed as soon as it is done."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files that led to it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in Arrow batches bounded by bytes: whole texts have no bound by
    rows.  Set once for the session, unless its user has set it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(4 * 2**20))
    return df


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fields(schema: T.StructType, **fields: str) -> T.StructType:
    """A new schema: ``schema`` and the named fields (DDL types) after it."""
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
