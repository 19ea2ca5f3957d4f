"""Late events and missing boards: what a stream may no longer count is kept, and the boards it belongs to are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import MODES, calendar_key, pending_key, recent_keys
from ..operators.boards import top_n


def with_lateness(events: DataFrame, batch: str, ts: str = "ts", late: str = "3 days") -> DataFrame:
    """`events` with `behind`: whether each is older than the watermark its batch began with, the latest time of all
    batches before less `late`.

    The highest time of each batch is summed up first; only those, a row a batch, go through one window.
    """
    highs = events.groupBy(batch).agg(F.max(ts).alias("_high"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = highs.select(batch, (F.max("_high").over(before) - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return events.join(marks, batch).withColumn("behind", F.coalesce(F.col(ts) < F.col("_mark"), F.lit(False))).drop("_mark")


def route(events: DataFrame, root: str, checkpoint: str, ts: str = "ts", late: str = "3 days") -> StreamingQuery:
    """Writes a stream's events to root/events and those behind the watermark to root/late, a folder a micro-batch.

    Each batch's highest time stands in root/marks, so that the watermark of a batch that is run again is the one it had.
    A batch replaces its own folders only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max(ts).alias("high")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        marks = spark.read.parquet(f"{root}/marks").filter(F.col("batch") < number)
        mark = marks.agg((F.max("high") - F.expr(f"INTERVAL {late}")).alias("mark"))
        behind = batch.join(F.broadcast(mark)).withColumn("_behind", F.coalesce(F.col(ts) < F.col("mark"), F.lit(False))).drop("mark")
        behind.filter("_behind").drop("_behind").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        behind.filter("NOT _behind").drop("_behind").write.mode("overwrite").parquet(f"{root}/events/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def repair_plan(late: DataFrame, boards: DataFrame, mode: str, now: str, days: int, ts: str = "ts", key: str = "key") -> DataFrame:
    """(key, late, missing): keys to make anew, because late events belong to them or because they are recent and have no
    board. The key whose first run is still ahead is left out."""
    spark = late.sparkSession
    pending = spark.range(1).select(pending_key(F.lit(now).cast("timestamp"), mode).alias(key)).filter(F.col(key).isNotNull())
    hit = late.select(calendar_key(ts, mode).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("late", F.lit(True))
    recent = recent_keys(spark, mode, days, now[:10])
    gone = recent.join(boards.select(key).distinct(), key, "left_anti").withColumn("missing", F.lit(True))
    both = hit.join(gone, key, "full").join(F.broadcast(pending), key, "left_anti")
    return both.select(key, F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("missing", F.lit(False)).alias("missing"))


def repaired_boards(events: DataFrame, plan: DataFrame, mode: str, ts: str = "ts", item: str = "user_id") -> DataFrame:
    """The boards of the planned keys from all their events, late ones included; keys without an event have none."""
    rows = events.select(calendar_key(ts, mode).alias("key"), item)
    counted = rows.join(plan.select("key"), "key", "left_semi").groupBy("key", item).agg(F.count(F.lit(1)).alias("votes"))
    return top_n(counted, ["key"], [F.desc("votes"), F.asc(item)], MODES[mode]["limit"])


def past_grace(references: DataFrame, orphans: DataFrame, now: str, key: str = "arxiv_id", since: str = "since", grace: str = "3 days") -> DataFrame:
    """The orphans that may go: unreferenced for the whole grace, and not referenced again since."""
    old = F.col(since) <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {grace}")
    return orphans.filter(old).join(references.select(key), key, "left_anti")
