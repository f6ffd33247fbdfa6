"""Writers: routed topics, JSON lines, splits, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows with a ``topic`` into one folder per topic. A batch that is done again
    replaces its own files, so a restart neither loses nor doubles rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "topic").json(folder)

    return write


def to_kafka(df: DataFrame, servers: str, checkpoint: str):
    """Stream of (topic, value) to the topics; needs the Kafka connector."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_splits(df: DataFrame, folder: str, split: str, order: str) -> None:
    """One folder per split, rows of a file in order."""
    df.repartitionByRange(F.col(split), F.col(order)).sortWithinPartitions(split, order).write.mode("overwrite").partitionBy(split).json(folder)


def write_single(df: DataFrame, folder: str) -> None:
    """One part file, for small documents such as metrics."""
    df.coalesce(1).write.mode("overwrite").json(folder)
