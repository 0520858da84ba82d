"""Streams over operation history and chunks; extras of this engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def rollup(history: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Runs and durations per operation and window, of a stream or table with completed_at, operation, duration."""
    w = F.window("completed_at", window)
    sums = history.withWatermark("completed_at", late).groupBy(w.alias("w"), "operation").agg(F.count(F.lit(1)).alias("runs"), F.sum("duration").alias("duration"))
    return sums.select(F.col("w.start").alias("window_start"), "operation", "runs", "duration")


def new_contents(chunks: DataFrame) -> DataFrame:
    """A stream's chunks without those whose cid it has had before."""
    return chunks.dropDuplicates(["cid"])


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns its result, kept as Parquet in the shared folder.

    Batches replace (complete) or add to the table under their own number, so a batch that runs again changes nothing.
    """
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)
