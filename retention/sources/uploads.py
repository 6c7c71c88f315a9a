"""Text uploads read line by line: stable row numbers (V1, C2) and malformed records.

A CSV folder or file is read as lines, so every line is accounted for.  A row's number is its place
among the data lines of the upload (files in path order, blank lines and each file's header left out,
from 0), whatever the split size or number of tasks: a first pass counts the lines of every split, the
counts per split (not rows) are summed up in order, and the second pass adds a line's place inside its
split.  No row is shuffled or sorted for it.

Lines whose number of fields differs from their header's, or with an open quote, are malformed: they keep
their text and reason and no cell of theirs is used, instead of being cut or filled with nulls."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cleaning import coerce_types, validate
from ..schema import RAW_SCHEMA, RECORD_COLUMNS
from ..session import scratch_path
from .readers import read_with_defaults

INDEX = "customer_index"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, customer_index, value) of every data line of the upload."""
    lines = (
        spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .filter(F.length(F.trim("value")) > 0)
        .withColumn("at", F.monotonically_increasing_id())  # consecutive inside a split
    )
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.min_by("value", "at").alias("line"))
    in_file = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumns({
        "before": F.sum("n").over(in_file) - F.col("n"), "header": F.first("line").over(in_file),
    })
    # one row a file
    files = splits.groupBy("file").agg((F.sum("n") - 1).alias("rows"))
    files = files.select("file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("start"))
    placed = splits.join(files, "file").select("file", "block", "low", "before", "start", F.ltrim(F.col("header"), F.lit("\ufeff")).alias("header"))
    place = F.col("before") + F.col("at") - F.col("low")
    return lines.join(placed, ["file", "block"]).filter(place > 0).select(
        "file", "header", (F.col("start") + place - 1).alias(INDEX), "value")


def _names(header: str) -> list[str]:
    return [c.strip().lower().replace(" ", "_") for c in next(csv.reader([header]))]


def _parsed(lines: DataFrame, names: list[str]) -> DataFrame:
    """The lines of one header as text cells, or as malformed records with their reason."""
    ddl = ", ".join(f"c{k} string" for k in range(len(names)))
    cells = F.from_csv("value", ddl, {"mode": "PERMISSIVE", "escape": '"'})
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    fields = F.regexp_count(F.regexp_replace("value", '"[^"]*"', ""), F.lit(",")) + 1  # commas outside of quotes
    reason: Column = F.when(quotes % 2 == 1, "open_quote").when(fields != len(names), "wrong_number_of_fields")
    out = lines.withColumn("x", cells).withColumn("malformed", reason)
    sound = F.col("malformed").isNull()
    cell = {}
    for k, name in enumerate(names):
        if name in RECORD_COLUMNS:  # of a name that stands twice, the first
            cell.setdefault(name, F.when(sound, F.col(f"x.c{k}")).alias(name))
    return out.select(INDEX, "file", "malformed", F.when(~sound, F.col("value")).alias("record"), *cell.values())


def read_upload(spark: SparkSession, path: str | list[str], id_prefix: str = "AUTO_") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a CSV upload.  ``rows`` has customer_index and the typed subscriber columns,
    absent ones with their defaults (other columns of the file are left out) and an absent id as ``AUTO_<customer_index>``; ``malformed`` has
    customer_index, file, malformed (the reason) and record (the line).

    Files may have different headers: one row per header comes to the driver, and each layout is read by
    name.  A path without files raises; an upload of headers only gives no rows."""
    lines = numbered_lines(spark, path)
    headers = sorted(r["header"] for r in lines.select("header").distinct().collect())
    # layouts with the same columns in the same order are one, however their headers are spelled
    layouts: dict[tuple[str, ...], list[str]] = {}
    for h in headers:
        layouts.setdefault(tuple(_names(h)), []).append(h)
    columns = [INDEX, "file", "malformed", "record", *RAW_SCHEMA.names]
    parsed = []
    for names, spelled in layouts.items():
        cells = coerce_types(_parsed(lines.filter(F.col("header").isin(*spelled)), list(names)))
        cells = read_with_defaults(cells, id_prefix, INDEX)
        if "churn" not in cells.columns:
            cells = cells.withColumn("churn", F.lit(None).cast("boolean"))
        parsed.append(cells.select(*columns))
    if not parsed:
        typed = coerce_types(spark.createDataFrame([], RAW_SCHEMA))
        parsed = [typed.select(F.lit(None).cast("long").alias(INDEX), *[F.lit(None).cast("string").alias(c) for c in columns[1:4]], "*")]
    # parsed once: both sides, and the numbers, are read from this table
    path = scratch_path(spark, "upload-parsed")
    functools.reduce(DataFrame.unionByName, parsed).write.parquet(path)
    table = spark.read.parquet(path)
    return table.filter("malformed is null").drop(*columns[1:4]), table.filter("malformed is not null").select(*columns[:4])


def upload_errors(rows: DataFrame, malformed: DataFrame, unknown_id: str = "unknown") -> DataFrame:
    """V1 / C2 error rows of an upload: customer_index, customer_id (``unknown`` where there is none) and
    error, rule codes or ``malformed_<reason>``."""
    _, bad = validate(rows)
    codes = bad.select(INDEX, F.coalesce("customer_id", F.lit(unknown_id)).alias("customer_id"), "error")
    lost = malformed.select(INDEX, F.lit(unknown_id).alias("customer_id"), F.concat(F.lit("malformed_"), "malformed").alias("error"))
    return codes.unionByName(lost)
