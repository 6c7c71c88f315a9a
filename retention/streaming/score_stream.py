"""Score subscriber files as they arrive in a directory (Structured Streaming).

The stream is stateless (no watermark needed).  Each micro-batch is scored with the
same functions as the batch path and written under ``<out>/scored/epoch=<id>`` and
``<out>/errors/epoch=<id>`` with overwrite, so a retried epoch replaces its own output
and the checkpoint gives each file to exactly one committed epoch.  Every file is read by its
own header: columns in any order, absent ones filled with the upload defaults.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import score_batch
from ..sources.readers import read_by_header


def start_scoring_stream(
    spark: SparkSession, input_dir: str, model: PipelineModel, output_dir: str, checkpoint_dir: str,
    available_now: bool = True, processing_time: str | None = None, max_files_per_trigger: int = 1000,
):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(input_dir).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def write_epoch(lines: DataFrame, epoch_id: int) -> None:
        # both outputs read the micro-batch (bounded by the trigger): parse the files once
        batch = read_by_header(lines.sparkSession, lines, f"AUTO_{epoch_id}_").persist()
        try:
            scored, errors = score_batch(batch, model)
            scored.write.mode("overwrite").parquet(os.path.join(output_dir, "scored", f"epoch={epoch_id}"))
            errors.write.mode("overwrite").parquet(os.path.join(output_dir, "errors", f"epoch={epoch_id}"))
        finally:
            batch.unpersist()

    w = lines.writeStream.foreachBatch(write_epoch).option("checkpointLocation", checkpoint_dir)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def score_directory_once(spark: SparkSession, input_dir: str, model: PipelineModel, output_dir: str, checkpoint_dir: str):
    """Process every file currently in ``input_dir`` and return (scored, errors) tables."""
    q = start_scoring_stream(spark, input_dir, model, output_dir, checkpoint_dir, available_now=True)
    q.awaitTermination()
    scored_path = os.path.join(output_dir, "scored")
    errors_path = os.path.join(output_dir, "errors")
    return spark.read.parquet(scored_path), spark.read.parquet(errors_path)
