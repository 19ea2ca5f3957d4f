"""Queries over calendar keys and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import text as T
from .common import load


def calendar_keys(spark, d):
    """Every day of the events with its keys, the Monday of its week and the last full week."""
    days = load(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    weekly = C.calendar_key("day", "weekly")
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("daily"), weekly.alias("weekly"), C.calendar_key("day", "monthly").alias("monthly"),
        F.date_format(C.monday_of(weekly), "yyyy-MM-dd").alias("monday"), C.last_full_week("day").alias("last_week"),
    )


def pending_keys(spark, d):
    """Keys that are still pending at each event's hour."""
    hours = load(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).distinct()
    return hours.select(F.date_format("at", "yyyy-MM-dd HH").alias("at_hour"), *(C.pending_key("at", m).alias(m) for m in C.MODES))


def key_validity(spark, d):
    """Which made-up keys are dates, weeks or months."""
    n = load(spark, d, "documents").select("doc_id")
    year, part, day = F.lpad((F.pmod("doc_id", F.lit(7)) + 2018).cast("string"), 4, "0"), F.lpad(F.pmod("doc_id", F.lit(60)).cast("string"), 2, "0"), F.lpad(F.pmod("doc_id", F.lit(33)).cast("string"), 2, "0")
    month = F.lpad(F.pmod("doc_id", F.lit(14)).cast("string"), 2, "0")
    keys = {"daily": F.concat_ws("-", year, month, day), "weekly": F.concat(year, F.lit("-W"), part), "monthly": F.concat_ws("-", year, month)}
    return n.select("doc_id", *(C.is_valid_key(k, m).alias(m) for m, k in keys.items()))


def search_hits(spark, d):
    """Share of the words of a phrase that each document holds."""
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.round(T.term_hit(T.search_text("text", "lang"), F.lit("License Version thing")), 4).alias("hit"), T.script_chars("text", T.NON_ASCII).cast("long").alias("other_script"))


def squeezed_lines(spark, d):
    """First lines with white space squeezed and markup entities escaped."""
    first = F.split("text", "\n")[0]
    return load(spark, d, "documents").select("doc_id", T.escape_entities(T.squeeze(first)).alias("line"), T.blank(first).alias("is_blank"))


QUERIES = {"calendar_keys": calendar_keys, "pending_keys": pending_keys, "key_validity": key_validity, "search_hits": search_hits, "squeezed_lines": squeezed_lines}

_KEY = {"daily": "%Y-%m-%d", "weekly": "%G-W%V", "monthly": "%Y-%m"}

ORACLE_SQL = {
    "calendar_keys": """
SELECT strftime(day, '%Y-%m-%d') AS daily, strftime(day, '%G-W%V') AS weekly, strftime(day, '%Y-%m') AS monthly,
  strftime(date_trunc('week', day), '%Y-%m-%d') AS monday, strftime(date_trunc('week', day) - INTERVAL 7 DAYS, '%G-W%V') AS last_week
FROM (SELECT DISTINCT ts::DATE AS day FROM events)""",
    "pending_keys": f"""
SELECT strftime(t, '%Y-%m-%d %H') AS at_hour, CASE WHEN hour(t) < 23 THEN strftime(t, '{_KEY["daily"]}') END AS daily,
  CASE WHEN isodow(t) - 1 < 6 OR (isodow(t) - 1 = 6 AND hour(t) < 2) THEN strftime(t, '{_KEY["weekly"]}') END AS weekly,
  CASE WHEN day(t) < 28 OR (day(t) = 28 AND hour(t) < 2) THEN strftime(t, '{_KEY["monthly"]}') END AS monthly
FROM (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events)""",
    "key_validity": """
WITH k AS (SELECT doc_id, (doc_id % 7 + 2018)::VARCHAR AS y, lpad((doc_id % 60)::VARCHAR, 2, '0') AS w, lpad((doc_id % 33)::VARCHAR, 2, '0') AS d, lpad((doc_id % 14)::VARCHAR, 2, '0') AS m FROM documents)
SELECT doc_id, try_cast(y || '-' || m || '-' || d AS DATE) IS NOT NULL AS daily,
  w::INTEGER BETWEEN 1 AND strftime(make_date(y::INTEGER, 12, 28), '%V')::INTEGER AS weekly, m::INTEGER BETWEEN 1 AND 12 AS monthly FROM k""",
    "search_hits": """
SELECT doc_id, round(CASE WHEN contains(t, 'license version thing') THEN 1.0 ELSE (contains(t, 'license')::INTEGER + contains(t, 'version')::INTEGER + contains(t, 'thing')::INTEGER) / 3.0 END::DOUBLE, 4) AS hit,
  length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS other_script FROM (SELECT doc_id, text, lower(text || ' ' || lang) AS t FROM documents)""",
    "squeezed_lines": """
SELECT doc_id, replace(replace(replace(replace(replace(trim(regexp_replace(f, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS line,
  trim(f, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS is_blank FROM (SELECT doc_id, string_split(text, chr(10))[1] AS f FROM documents)""",
}
