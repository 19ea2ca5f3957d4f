"""What is left to do: candidates for a retry, ids to attempt once, capped lists, stale reports, sound requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retry_candidates(entries: DataFrame, status: str, tainted: str, valid_file: Column) -> DataFrame:
    """Entries that are tainted, failed, or ok without a valid file. Missing values count as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = F.col(status)
    return entries.filter(yes(F.col(tainted)) | yes(state == "failed") | (yes(state == "ok") & ~yes(valid_file)))


def attempts(indexes: list[DataFrame], key: str) -> DataFrame:
    """Each id of all indexes once, with the number of indexes that refer to it: what a run attempts."""
    each = reduce(DataFrame.unionByName, (x.select(key).distinct() for x in indexes))
    return each.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("indexes"))


def fan_out(outcomes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The outcome of each attempted id at every entry that refers to it."""
    return index.join(outcomes, key, "left")


def common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides hold, once each."""
    return left.select(*keys).intersect(right.select(*keys))


def capped(work: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` keys in order, and one row (listed, skipped) that tells what the cap left out."""
    first = work.select(key).distinct().orderBy(key).limit(limit)
    told = work.agg(F.count_distinct(key).alias("n")).select(F.least("n", F.lit(limit)).cast("long").alias("listed"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("skipped"))
    return first, told


def cut_off(rows: DataFrame, by: list[str], pos: str, limit: int) -> DataFrame:
    """The first `limit` rows of each group by position; `truncated` where the group holds one more."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    near = rows.withColumn("_n", place).filter(F.col("_n") <= limit + 1)
    more = F.max("_n").over(Window.partitionBy(*by)) > limit
    return near.withColumn("truncated", more).filter(F.col("_n") <= limit).drop("_n")


def stale(wanted: DataFrame, recorded: DataFrame, key: str, signature: list[str], age: Column | None = None, max_age: int | None = None) -> DataFrame:
    """Rows of `wanted` to compute again: no record has their key and signature, or it is older than allowed."""
    usable = recorded if age is None or max_age is None else recorded.filter(age <= max_age)
    return wanted.join(usable.select(key, *signature).distinct(), [key, *signature], "left_anti")


def request_fault(text: Column, limit: int, pattern: str | None = None, required: bool = True) -> Column:
    """Why a field of a request is refused, null for a sound one."""
    said = F.trim(F.coalesce(text, F.lit("")))
    empty = said == ""
    out = F.when(empty, F.lit("missing") if required else F.lit(None))
    out = out.when(F.char_length(said) > limit, "too long").when(said.rlike(r"[\x00-\x1F\x7F]"), "control character")
    return out.when(~said.rlike(pattern), "not valid") if pattern else out


def upsert_topics(topics: DataFrame, profiles: DataFrame, key: str = "slug", name: str = "display_name") -> DataFrame:
    """Topics with new and changed profiles: fields of a profile hold where they are set; a display name that a
    profile leaves out stays. Both sides have the same columns."""
    old, new = topics.alias("o"), profiles.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in topics.columns))


def list_topics(topics: DataFrame, enabled: bool | None = None, at: str = "updated_at", flag: str = "enabled") -> DataFrame:
    """Topics, the latest first; with `enabled`, those whose flag (on where missing) is that."""
    on = F.coalesce(F.col(flag), F.lit(True))
    return (topics if enabled is None else topics.filter(on == enabled)).orderBy(F.desc(at))
