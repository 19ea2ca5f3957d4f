"""Bounds of what Python functions get of a table at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and Python: what a task holds of the texts at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches in bytes; by itself Spark bounds only their rows, and long texts add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    size = int(digits or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get((now or "b").lower().rstrip("b")[-1:], 1)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    # Functions bound what they return themselves. Cut by Spark, a batch above a limit reaches the JVM without
    # columns and the task fails.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerOutputBatch", "-1")
    return spark
