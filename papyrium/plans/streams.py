"""Queries over late events and keyed jobs, in the batch form of what the streams do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.calendar import calendar_key
from ..streaming import jobs, repair
from .common import load

_STUCK = dt.timedelta(hours=12)


def _arrivals(spark, d):
    """Events in twenty batches, in which they come out of order."""
    rows = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return repair.with_lateness(rows.withColumn("batch", (F.col("event_id") * 7919) % 20), "batch", late="3 days")


def late_events(spark, d):
    """By day: events in time, events behind the watermark of their batch, and the latest of these."""
    behind = F.col("behind")
    return _arrivals(spark, d).groupBy(calendar_key("ts", "daily").alias("key")).agg(
        F.count_if(~behind).alias("in_time"), F.count_if(behind).alias("late"), F.date_format(F.max(F.when(behind, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_late")
    )


def repaired_boards(spark, d):
    """Weekly boards made anew from all events, where events came late or a recent week has no board (of odd weeks)."""
    rows = _arrivals(spark, d)
    have = rows.filter("NOT behind").select(calendar_key("ts", "weekly").alias("key")).distinct().filter(F.substring("key", -1, 1).cast("int") % 2 == 1)
    plan = repair.repair_plan(rows.filter("behind AND ts < '2024-01-20'"), have, "weekly", "2024-01-31 12:00:00", 28)
    return repair.repaired_boards(rows, plan, "weekly").select("key", "user_id", "votes", "rank").join(plan, "key")


def job_outcomes(spark, d):
    """Events as a user's jobs: a purchase asks for one, a signup ends it, an error fails it."""
    kind = F.when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "error", "error").otherwise("other")
    rows = load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), "event_id")
    out = jobs.outcomes(rows, stuck=_STUCK, last="event_id")
    return out.select(F.col("key").cast("long").alias("user_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "kind", "outcome")


QUERIES = {"late_events": late_events, "repaired_boards": repaired_boards, "job_outcomes": job_outcomes}

_ARRIVALS = """
a AS (SELECT event_id, ts, user_id, (event_id * 7919) % 20 AS batch FROM events),
h AS (SELECT batch, max(ts) AS high FROM a GROUP BY batch),
m AS (SELECT batch, max(high) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS mark FROM h),
e AS (SELECT a.*, coalesce(ts < mark, false) AS behind, strftime(ts, '%G-W%V') AS week FROM a JOIN m USING (batch))"""

ORACLE_SQL = {
    "late_events": f"""
WITH {_ARRIVALS}
SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) FILTER (WHERE NOT behind) AS in_time, count(*) FILTER (WHERE behind) AS late,
  strftime(max(ts) FILTER (WHERE behind), '%Y-%m-%d %H:%M:%S') AS last_late FROM e GROUP BY 1""",
    "repaired_boards": f"""
WITH {_ARRIVALS},
have AS (SELECT DISTINCT week FROM e WHERE NOT behind AND right(week, 1)::INT % 2 = 1),
hit AS (SELECT DISTINCT week FROM e WHERE behind AND ts < TIMESTAMP '2024-01-20'),
recent AS (SELECT DISTINCT strftime(d, '%G-W%V') AS week FROM range(DATE '2024-01-04', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
plan AS (
  SELECT week, week IN (FROM hit) AS late, week IN (FROM recent) AND week NOT IN (FROM have) AS missing
  FROM (SELECT week FROM hit UNION SELECT week FROM recent) WHERE week <> '2024-W05'
), c AS (SELECT week, user_id, count(*) AS votes FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY votes DESC, user_id) AS rank FROM c)
SELECT week AS key, user_id, votes, rank, late, missing FROM r JOIN plan USING (week) WHERE (late OR missing) AND rank <= 10""",
    "job_outcomes": """
WITH RECURSIVE k AS (
  SELECT user_id, ts AS w, CASE event_type WHEN 'purchase' THEN 'request' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'error' ELSE 'other' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), r AS (
  SELECT user_id, 0::BIGINT AS n, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS w, ''::VARCHAR AS kind, NULL::TIMESTAMP AS was, false AS expired FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, CASE WHEN kind = 'request' THEN coalesce(live, w) WHEN kind IN ('done', 'error') THEN NULL ELSE live END, w, kind, live, expired FROM (
    SELECT *, CASE WHEN expired THEN NULL ELSE since END AS live FROM (
      SELECT k.user_id, k.n, k.w, k.kind, r.since, coalesce(k.w >= r.since + INTERVAL 12 HOUR, false) AS expired FROM r JOIN k ON k.user_id = r.user_id AND k.n = r.n + 1
    )
  )
), s AS (SELECT *, lag(since) OVER (PARTITION BY user_id ORDER BY n) AS begun FROM r)
SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS "at", kind, outcome FROM (
  SELECT user_id, w, kind, CASE WHEN kind = 'request' THEN CASE WHEN was IS NULL THEN 'started' ELSE 'refused' END WHEN kind = 'other' OR was IS NULL THEN 'ignored' WHEN kind = 'done' THEN 'finished' ELSE 'failed' END AS outcome FROM s WHERE n > 0
  UNION ALL
  SELECT user_id, begun + INTERVAL 12 HOUR, 'timer', 'reset' FROM s WHERE expired
)""",
}
