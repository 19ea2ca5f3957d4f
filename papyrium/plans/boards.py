"""Queries over leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as B
from .common import load

_KEYS = {"daily": "%Y-%m-%d", "weekly": "%G-W%V", "monthly": "%Y-%m"}


def _board_sql(mode: str, limit: int) -> str:
    return f"""
SELECT '{mode}' AS mode, key, user_id, votes, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY votes DESC, user_id) AS rank
  FROM (SELECT strftime(ts, '{_KEYS[mode]}') AS key, user_id, count(*) AS votes FROM events GROUP BY ALL)
) WHERE rank <= {limit}"""


_LIMITS = {m: x["limit"] for m, x in B.MODES.items()}
_ENTRIES_SQL = " UNION ALL ".join(f"({_board_sql(m, n)})" for m, n in _LIMITS.items())


def _of(mode):
    return lambda spark, d: B.board(load(spark, d, "events"), mode)


def _entries(spark, d):
    return B.all_boards(load(spark, d, "events"))


def entries_by_mode(spark, d):
    return B.entries_by_mode(_entries(spark, d))


def reference_index(spark, d):
    return B.reference_index(_entries(spark, d))


def max_votes(spark, d):
    daily = load(spark, d, "events").groupBy(B.calendar_key("ts", "daily").alias("key"), "user_id").agg(F.count(F.lit(1)).alias("votes"))
    return B.max_votes(daily, "2024-01-31")


def vote_window_7d(spark, d):
    daily = load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("votes"))
    out = B.trailing_window(daily, "user_id", "day", "votes", 7)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "votes", F.col("trailing").alias("votes_7d"))


def recent_board_keys(spark, d):
    return B.recent_and_older(_entries(spark, d))


def board_listing(spark, d):
    seen = load(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("user_id"), F.lit(True).alias("ok"))
    rows = _entries(spark, d).join(seen, "user_id", "left").withColumn("published", F.coalesce("ok", F.lit(False))).withColumn("generated_at", F.col("key"))
    return B.listing(rows).select("mode", "key", "papers", "published")


def event_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return load(spark, d, "events").select(k.alias("k"), "value").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def seen_dedupe(spark, d):
    """The first event of each user and type."""
    e = load(spark, d, "events")
    first = F.min(F.struct("ts", "event_id"))
    return e.groupBy("user_id", "event_type").agg(first.alias("x")).select("user_id", "event_type", F.col("x.event_id").alias("event_id"), F.date_format("x.ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


QUERIES = {
    "leaderboard_daily": _of("daily"),
    "leaderboard_weekly": _of("weekly"),
    "leaderboard_monthly": _of("monthly"),
    "entries_by_mode": entries_by_mode,
    "reference_index": reference_index,
    "max_votes": max_votes,
    "vote_window_7d": vote_window_7d,
    "recent_board_keys": recent_board_keys,
    "board_listing": board_listing,
    "event_props": event_props,
    "seen_dedupe": seen_dedupe,
}

ORACLE_SQL = {
    **{f"leaderboard_{m}": _board_sql(m, n) for m, n in _LIMITS.items()},
    "entries_by_mode": f"SELECT mode, count(*) AS entries, count(DISTINCT key) AS keys FROM ({_ENTRIES_SQL}) GROUP BY mode",
    "reference_index": f"""
SELECT user_id, string_agg(place, ',' ORDER BY place) AS places, count(*) AS n_places
FROM (SELECT DISTINCT user_id, mode || ':' || key AS place FROM ({_ENTRIES_SQL})) GROUP BY user_id""",
    "max_votes": """
SELECT user_id, max(votes) AS max_votes
FROM (SELECT strftime(ts, '%Y-%m-%d') AS key, user_id, count(*) AS votes FROM events GROUP BY ALL)
WHERE key BETWEEN '2024-01-25' AND '2024-01-31' GROUP BY user_id""",
    "vote_window_7d": """
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, votes,
  sum(votes) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS votes_7d
FROM (SELECT ts::DATE AS day, user_id, count(*) AS votes FROM events GROUP BY ALL)""",
    "recent_board_keys": f"""
SELECT mode, key, row_number() OVER (PARTITION BY mode ORDER BY key DESC) <= 12 AS recent
FROM (SELECT DISTINCT mode, key FROM ({_ENTRIES_SQL}))""",
    "board_listing": f"""
SELECT mode, key, count(*) AS papers, count(l.doc_id) AS published
FROM ({_ENTRIES_SQL}) e LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = e.user_id GROUP BY mode, key""",
    "event_props": "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "seen_dedupe": """
SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events
) WHERE n = 1""",
}
