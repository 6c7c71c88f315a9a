"""A keyed table stored by key hash (U1-U3): a merge reads and writes only the parts its changes touch.

The table lies in ``parts`` folders by a hash of the key.  The parts touched by a change set are known
before the base is read (at most ``parts`` numbers, brought to the driver) and stand in the plan as
literals, so the scan lists and reads those folders only.  The merged parts are first written whole to
a staging folder of the batch and then published by dynamic partition overwrite, which leaves every other
folder as it is.  A batch that fails while publishing is published again from its staging folder, and a
batch that is repeated after it was published changes nothing: both by the batch's id.

New ids (D17) come from ranges that a batch reserves in a high-water table: ids are never looked up in
the base, and interleaved batches never share a number."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.readers import _exists
from . import tables
from .ordered import sequence_numbers

PART = "part"


class KeyedStore:
    """The table at ``path``; ``parts`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, key: str = "customer_id"):
        self.spark, self.root, self.key = spark, path.rstrip("/"), key
        self.path = f"{self.root}/table"

    def create(self, df: DataFrame, parts: int = 64) -> KeyedStore:
        """Store ``df``.  Keys that parse as ids move the high water; pick ``parts`` so that a folder
        holds a few GB."""
        self.spark.createDataFrame([(parts,)], "parts int").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/layout")
        df.withColumn(PART, self._part(parts)).repartition(parts, PART).write.mode("errorifexists").partitionBy(PART).parquet(self.path)
        df.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/schema")
        self.reserve("created", 0, self._highest(df))
        return self

    def _highest(self, df: DataFrame) -> int:
        return int(df.select(F.max(tables.parse_id_number(F.col(self.key)))).first()[0] or 0)

    def _columns(self) -> T.StructType:
        """The stored columns and the part."""
        return T.StructType([*self.spark.read.parquet(f"{self.root}/schema").schema.fields, T.StructField(PART, T.IntegerType())])

    @property
    def parts(self) -> int:
        return self.spark.read.parquet(f"{self.root}/layout").first()["parts"]

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(parts)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or the named parts of it."""
        columns = self._columns()
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], columns).drop(PART)
        df = self.spark.read.schema(columns).parquet(self.path)
        if only is not None:
            df = df.filter(F.col(PART).isin(*only)) if only else df.filter(F.lit(False))
        return df.drop(PART)

    # -- batches ---------------------------------------------------------------------------

    def _apply(self, batch: str, touched: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Merge one batch into the parts that hold the keys of ``touched``; their numbers."""
        staging, done = (f"{self.root}/{kind}/{batch}" for kind in ("staging", "published"))
        if _exists(self.spark, f"{done}/_SUCCESS"):
            return [r[PART] for r in self.spark.read.parquet(done).collect()]
        parts = self.parts
        if not _exists(self.spark, f"{staging}/parts/_SUCCESS"):
            numbers = [r[0] for r in touched.select(self._part(parts).alias(PART)).distinct().collect()]
            rows = merged(self.read(numbers)).withColumn(PART, self._part(parts))
            rows.write.mode("overwrite").partitionBy(PART).parquet(f"{staging}/rows")
            # written last: the staged rows are whole once this is there
            self.spark.createDataFrame([(n,) for n in sorted(numbers)], f"{PART} int").coalesce(1).write.mode("overwrite").parquet(f"{staging}/parts")
        numbers = [r[PART] for r in self.spark.read.parquet(f"{staging}/parts").collect()]
        self._publish(f"{staging}/rows", numbers)
        self.spark.createDataFrame([(n,) for n in numbers], f"{PART} int").coalesce(1).write.mode("overwrite").parquet(done)
        return numbers

    def _publish(self, staged: str, numbers: list[int]) -> None:
        rows = self.spark.read.schema(self._columns()).parquet(staged)
        rows.repartition(max(1, len(numbers)), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        # a part left without rows has no staged folder, so its old one has to go
        held = {r[PART] for r in rows.select(PART).distinct().collect()}
        jvm = self.spark.sparkContext._jvm
        for n in set(numbers) - held:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={n}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def upsert(self, changes: DataFrame, order_col: str, batch: str) -> list[int]:
        """U1 + D17: replace by key, append the rest, null keys get reserved ids; the touched parts."""
        fresh = changes.filter(F.col(self.key).isNull())
        low = self.reserve(batch, fresh.count(), self._highest(changes))  # explicit ids move the high water too
        named = sequence_numbers(fresh, order_col, "_seq").withColumn(
            self.key, tables.format_id(F.lit(low).cast("decimal(38,0)") + F.col("_seq"))).drop("_seq")
        keyed = changes.filter(F.col(self.key).isNotNull()).unionByName(named)
        # ids and versions are settled once, before the parts are chosen by them
        path = scratch_path(self.spark, "changes")
        tables.latest_per_key(keyed, order_col, self.key).write.parquet(path)
        latest = self.spark.read.parquet(path)
        return self._apply(batch, latest, lambda base: tables._replace(base, latest, self.key))

    def update_existing(self, changes: DataFrame, order_col: str, batch: str) -> list[int]:
        """Changes to stored keys only."""
        keyed = changes.filter(F.col(self.key).isNotNull())
        return self._apply(batch, keyed, lambda base: tables.update_existing(base, keyed, order_col, self.key)[0])

    def delete(self, ids: DataFrame, batch: str) -> list[int]:
        """Drop the given keys."""
        return self._apply(batch, ids.select(self.key), lambda base: tables.delete(base, ids, self.key)[0])

    # -- id ranges -------------------------------------------------------------------------

    def _claims(self) -> list[tuple[int, str, int, int]]:
        """(slot, batch, low, high) of every reserved range, in order; one line a batch."""
        folder = f"{self.root}/id_ranges"
        if not _exists(self.spark, folder):
            return []
        lines = self.spark.read.text(folder).collect()
        return sorted((int(slot), batch, int(low), int(high)) for slot, low, high, batch in (r["value"].split(" ", 3) for r in lines))

    def _claim(self, batch: str, n: int, at_least: int) -> int:
        """Take the next ``n`` numbers above all earlier ranges and ``at_least``.  A range is a file
        named by its place in the order and created exclusively: of two batches that want the same
        place, one gets it and the other looks again."""
        sc = self.spark.sparkContext
        for _ in range(100):
            claims = self._claims()
            for _, name, low, _ in claims:
                if name == batch:
                    return low
            slot = claims[-1][0] + 1 if claims else 0
            low = max(claims[-1][3] if claims else 0, at_least)
            place = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/id_ranges/slot-{slot:08d}")
            try:
                out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, False)
            except Py4JJavaError:  # taken meanwhile
                time.sleep(0.1)
                continue
            out.writeBytes(f"{slot} {low} {low + n} {batch}\n")
            out.close()
            return low
        raise RuntimeError(f"no place in {self.root}/id_ranges: a batch that failed has left an empty file there")

    def reserve(self, batch: str, n: int, at_least: int = 0) -> int:
        """The number before the ``n`` new ones of this batch; a repeated batch gets the same range."""
        if "/" in batch or "\n" in batch or not batch:
            raise ValueError("a batch id is a plain name")
        return self._claim(batch, n, at_least)
