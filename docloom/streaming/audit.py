"""Log rows as an append-only stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def start_append(log: DataFrame, path: str, checkpoint_path: str):
    """Write arriving log rows once each, partitioned by event day."""
    return (
        log.withColumn("day", F.substring("timestamp", 1, 10))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_path)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )
