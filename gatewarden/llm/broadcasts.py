"""Broadcast of models and query sets behind a check of their size."""

from __future__ import annotations

import pickle

from pyspark import Broadcast
from pyspark.sql import SparkSession

MAX_BYTES = 64 << 20


def bounded(spark: SparkSession, value, limit: int = MAX_BYTES) -> Broadcast:
    """Broadcast ``value``; refuses one whose pickled size is over ``limit``."""
    size = len(pickle.dumps(value, protocol=pickle.HIGHEST_PROTOCOL))
    if size > limit:
        raise ValueError(f"{size} bytes to broadcast are over the limit of {limit}: take it in smaller blocks")
    return spark.sparkContext.broadcast(value)
