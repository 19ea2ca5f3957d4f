"""Leaderboards: counted items by calendar key, Top-N with ranks, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import MODES, calendar_key


def top_n(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each group in a total order, ranked from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def board(events: DataFrame, mode: str, *, ts: str = "ts", item: str = "user_id", limit: int | None = None) -> DataFrame:
    """mode, key, item, votes and rank: most events first, ties by item.

    Events are counted by key and item in the tasks before they are dealt, so a hot day is one row an
    item and task.
    """
    counted = events.groupBy(calendar_key(ts, mode).alias("key"), F.col(item)).agg(F.count(F.lit(1)).alias("votes"))
    ranked = top_n(counted, ["key"], [F.desc("votes"), F.asc(item)], limit or MODES[mode]["limit"])
    return ranked.select(F.lit(mode).alias("mode"), "key", item, "votes", "rank")


def all_boards(events: DataFrame, ts: str = "ts", item: str = "user_id") -> DataFrame:
    """The boards of all modes as one table: the events are read once, and dealt once by mode, key and item."""
    keys = F.array(*(F.struct(F.lit(m).alias("mode"), calendar_key(ts, m).alias("key"), F.lit(MODES[m]["limit"]).alias("limit")) for m in MODES))
    counted = events.select(item, F.inline(keys)).groupBy("mode", "key", "limit", item).agg(F.count(F.lit(1)).alias("votes"))
    ranked = top_n(counted, ["mode", "key"], [F.desc("votes"), F.asc(item)], max(m["limit"] for m in MODES.values()))
    return ranked.filter("rank <= limit").select("mode", "key", item, "votes", "rank")


def entries_by_mode(entries: DataFrame) -> DataFrame:
    return entries.groupBy("mode").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("key").alias("keys"))


def max_votes(daily: DataFrame, last_key: str, days: int = 7, item: str = "user_id") -> DataFrame:
    """The most votes of each item on one of the last `days` daily boards; null votes are 0."""
    first = F.date_format(F.date_sub(F.to_date(F.lit(last_key)), days - 1), "yyyy-MM-dd")
    recent = daily.filter(F.col("key").between(first, F.lit(last_key)))
    return recent.groupBy(item).agg(F.max(F.coalesce("votes", F.lit(0))).alias("max_votes"))


def reference_index(entries: DataFrame, item: str = "user_id") -> DataFrame:
    """For each item the places that hold it: mode:key, in order, and how many."""
    places = F.sort_array(F.collect_set(F.concat_ws(":", "mode", "key")))
    return entries.groupBy(item).agg(places.alias("places")).select(item, F.array_join("places", ",").alias("places"), F.size("places").cast("long").alias("n_places"))


def listing(entries: DataFrame, published: str = "published", stamp: str = "generated_at") -> DataFrame:
    """For each mode and key: rows, published rows and the time of the board, latest key first."""
    out = entries.groupBy("mode", "key").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.col(published).cast("int")).alias("published"), F.max(stamp).alias(stamp))
    return out.orderBy("mode", F.desc("key"))


def recent_and_older(keys: DataFrame, n: int = 12) -> DataFrame:
    """Each key with whether it is one of the `n` latest of its mode."""
    w = Window.partitionBy("mode").orderBy(F.desc("key"))
    return keys.select("mode", "key").distinct().withColumn("recent", F.row_number().over(w) <= n)


def trailing_window(daily: DataFrame, item: str, day: str, value: str, days: int = 7) -> DataFrame:
    """The sum of `value` over each row's day and the days before it, `days` in all."""
    w = Window.partitionBy(item).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)
    return daily.withColumn("trailing", F.sum(value).over(w))
