"""Queries over work lists: retries, attempts, caps, stale reports and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import worklists as W
from .common import STATUSES_SQL, load, statuses

#: Below so many characters a document stands for one without a valid file.
VALID_CHARS = 200
FIRST_IDS, FIRST_LINES = 100, 5


def retry_candidates(spark, d):
    both = load(spark, d, "documents").select("doc_id", "n_chars").join(statuses(spark, d), "doc_id", "left")
    return W.retry_candidates(both, "status", "tainted", F.col("n_chars") >= VALID_CHARS).select("doc_id", "status", "tainted")


def _indexes(spark, d):
    daily = load(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    return [daily, load(spark, d, "labels"), load(spark, d, "documents")]


def attempts(spark, d):
    return W.attempts(_indexes(spark, d), "doc_id")


def common_ids(spark, d):
    seen, labelled, docs = _indexes(spark, d)
    return W.common(W.common(docs, labelled, ["doc_id"]), seen, ["doc_id"])


def capped_worklist(spark, d):
    work = W.retry_candidates(load(spark, d, "documents").join(statuses(spark, d), "doc_id", "left"), "status", "tainted", F.col("n_chars") >= VALID_CHARS)
    first, told = W.capped(work, "doc_id", FIRST_IDS)
    return first.agg(F.sum("doc_id").alias("ids")).crossJoin(told)


def cut_off_lines(spark, d):
    """The first lines of each document, and whether there are more."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.cut_off(lines, ["doc_id"], "pos", FIRST_LINES).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("chars"), "truncated")


def stale_reports(spark, d):
    """Documents whose recorded report, of labelled ones, has another policy or size, or is too old."""
    docs = load(spark, d, "documents").select("doc_id", F.lit(1).alias("policy"), F.col("n_chars").alias("size"))
    noted = load(spark, d, "labels").join(docs.select("doc_id", "size"), "doc_id").select("doc_id", F.col("quality").alias("policy"), "size", F.col("toxic").alias("age"))
    return W.stale(docs, noted, "doc_id", ["policy", "size"], F.col("age"), 0).select("doc_id", "size")


def request_faults(spark, d):
    """Turns as request fields: the first reason against each."""
    turns = load(spark, d, "conversations")
    return turns.select("conv_id", "turn", W.request_fault(F.col("text"), 120, r"^[A-Za-z0-9]").alias("fault"))


def topic_upsert(spark, d):
    topics = load(spark, d, "nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("display_name"), F.col("n_nationkey").cast("long").alias("updated_at"))
    busy = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nations = load(spark, d, "nation").join(busy, F.col("n_nationkey") == F.col("c_nationkey"))
    known = nations.select(F.lower("n_name").alias("slug"), F.lit(None).cast("string").alias("display_name"), (F.col("n") + 1000).alias("updated_at"))
    regions = load(spark, d, "region").select(F.lower("r_name").alias("slug"), F.col("r_name").alias("display_name"), F.lit(1).cast("long").alias("updated_at"))
    return W.list_topics(W.upsert_topics(topics, known.unionByName(regions)))


QUERIES = {
    "retry_candidates": retry_candidates,
    "attempts_once": attempts,
    "common_ids": common_ids,
    "capped_worklist": capped_worklist,
    "cut_off_lines": cut_off_lines,
    "stale_reports": stale_reports,
    "request_faults": request_faults,
    "topic_upsert": topic_upsert,
}

_RETRY = f"""
WITH {STATUSES_SQL}, r AS (
  SELECT doc_id, status, tainted FROM documents LEFT JOIN statuses USING (doc_id)
  WHERE coalesce(tainted, FALSE) OR coalesce(status = 'failed', FALSE) OR (coalesce(status = 'ok', FALSE) AND NOT coalesce(n_chars >= {VALID_CHARS}, FALSE)))"""

ORACLE_SQL = {
    "retry_candidates": f"{_RETRY} SELECT * FROM r",
    "attempts_once": """
SELECT doc_id, count(*) AS indexes FROM (
  SELECT DISTINCT user_id AS doc_id FROM events UNION ALL SELECT DISTINCT doc_id FROM labels UNION ALL SELECT DISTINCT doc_id FROM documents) GROUP BY doc_id""",
    "common_ids": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT user_id FROM events",
    "capped_worklist": f"""{_RETRY}, n AS (SELECT DISTINCT doc_id FROM r)
SELECT (SELECT sum(doc_id)::BIGINT FROM (SELECT doc_id FROM n ORDER BY doc_id LIMIT {FIRST_IDS})) AS ids, least(count(*), {FIRST_IDS})::BIGINT AS listed, greatest(count(*) - {FIRST_IDS}, 0)::BIGINT AS skipped FROM n""",
    "cut_off_lines": f"""
SELECT doc_id, pos - 1 AS pos, length(line) AS chars, n > {FIRST_LINES} AS truncated FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents)
WHERE pos <= {FIRST_LINES}""",
    "stale_reports": """
SELECT doc_id, n_chars AS size FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic <= 0 AND d.n_chars IS NOT NULL)""",
    "request_faults": r"""
SELECT conv_id, turn, CASE WHEN t = '' THEN 'missing' WHEN length(t) > 120 THEN 'too long' WHEN regexp_matches(t, '[\x00-\x1F\x7F]') THEN 'control character'
  WHEN NOT regexp_matches(t, '^[A-Za-z0-9]') THEN 'not valid' END AS fault
FROM (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS t FROM conversations)""",
    "topic_upsert": """
WITH busy AS (SELECT lower(n_name) AS slug, count(*) + 1000 AS updated_at FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1)
SELECT lower(n_name) AS slug, n_name AS display_name, coalesce(b.updated_at, n_nationkey)::BIGINT AS updated_at FROM nation LEFT JOIN busy b ON b.slug = lower(n_name)
UNION ALL SELECT lower(r_name), r_name, 1 FROM region""",
}
