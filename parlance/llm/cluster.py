"""Small helpers about the session: shared checkpoints and partition counts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parlance.runtime import checkpointed, release

__all__ = ["checkpointed", "partitions", "release"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
