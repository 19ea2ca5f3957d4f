"""Streaming forms of boards, dedupe and repair, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import calendar_key
from ..schemas import EVENT

#: Weeks begin on Monday: windows of seven days from the epoch, a Thursday, are shifted by four.
WINDOWS = {"daily": ("1 day", "1 day", "0 days"), "weekly": ("7 days", "7 days", "4 days")}


def read_events(spark, path: str, max_files: int = 1) -> DataFrame:
    """Parquet events as a stream with a proper timestamp."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, mode: str, late: str = "3 days", item: str = "user_id") -> DataFrame:
    """Counts by calendar window and item; events later than `late` are dropped and state is freed."""
    marked = events.withWatermark("ts", late)
    if mode == "monthly":  # months have no fixed length: the key is the first day
        return marked.groupBy(F.window("ts", "1 day"), F.col(item), calendar_key("ts", "monthly").alias("key")).agg(F.count(F.lit(1)).alias("votes"))
    size, step, start = WINDOWS[mode]
    return marked.groupBy(F.window("ts", size, step, start), F.col(item)).agg(F.count(F.lit(1)).alias("votes")).withColumn("key", calendar_key("window.start", mode))


def sliding_counts(events: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "3 days", item: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), F.col(item)).agg(F.count(F.lit(1)).alias("votes"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "3 days", item: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col(item)).agg(F.count(F.lit(1)).alias("events"))


def first_seen(events: DataFrame, keys: list[str], late: str = "3 days") -> DataFrame:
    """The first event of each key; a key is remembered for as long as the watermark allows.

    A set of seen keys without limit would need state without limit: the bound is part of the contract.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def refresh_boards(events: DataFrame, root: str, mode: str, checkpoint: str, limit: int | None = None) -> StreamingQuery:
    """Recomputes each board that a micro-batch touches, from all its counts, into root/board/key=...

    Counts come in complete per key and item (update mode) and are only ever added: a batch writes a folder of
    its own, root/counts/batch=N/key=..., and a later batch's count of an item is the one that holds. A batch
    that fails midway and is run again writes that folder anew and reads those before it, which nothing
    changes. Only folders of the touched keys are read. Boards are derived and replaced whole by key.
    """
    from ..functions.calendar import MODES
    from ..operators.boards import top_n

    n = limit or MODES[mode]["limit"]
    totals = counts(events, mode).groupBy("key", "user_id").agg(F.sum("votes").alias("votes")) if mode == "monthly" else counts(events, mode).select("key", "user_id", "votes")
    schema = T.StructType([totals.schema["user_id"], totals.schema["votes"], T.StructField("batch", T.LongType()), T.StructField("key", T.StringType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("user_id", "votes", "key").write.mode("overwrite").partitionBy("key").parquet(f"{root}/counts/batch={number}")
        every = spark.read.schema(schema).parquet(f"{root}/counts").filter(F.col("batch") <= number)
        touched = every.filter(F.col("batch") == number).select("key").distinct()
        latest = every.join(F.broadcast(touched), "key", "left_semi").groupBy("key", "user_id").agg(F.max_by("votes", "batch").alias("votes"))
        board = top_n(latest, ["key"], [F.desc("votes"), F.asc("user_id")], n)
        board.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{root}/board")

    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
