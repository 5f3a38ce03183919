"""Incremental ingestion: files that arrive are processed once, by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends what is new in ``source`` (parquet) to ``sink`` and stops when all of it is done.

    Each batch is written by its id, so a batch that is repeated after a failure replaces
    itself instead of being doubled."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
