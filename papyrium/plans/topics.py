"""Queries over topic rankings and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import freshness
from ..functions.text import slug
from ..operators import ranking as R
from ..operators import search as S
from ..operators.boards import all_boards
from .boards import _ENTRIES_SQL
from .common import CANDIDATES_SQL, VOTES_SQL, candidates, load, votes

KEY_DATE = "2024-01-30"
DAYS = 25
PROFILES = [
    {"slug": "main", "query": "the thing", "generated_terms": {"must": ["the that", "thing"], "should": ["with", "for the", "was onthe"], "negative": ["worthless"]}, "categories": ["en", "src1"]},
    {"slug": "romance", "query": "de la", "generated_terms": {"must": [], "should": ["que", "les"], "negative": []}, "categories": ["fr", "es"], "weights": {"relevance": 0.6, "freshness": 0.2, "votes": 0.2}},
    {"slug": "open", "query": "license version", "generated_terms": {"must": ["license"], "should": ["apache", "version 2.0"], "negative": ["stupid"]}, "categories": []},
]


def _ranked(spark, d, profiles, limit, seen=None):
    rows = R.fresh_candidates(candidates(spark, d), KEY_DATE, DAYS, item="doc_id", order="doc_id")
    return R.rank_candidates(rows, R.profile_table(spark, profiles), votes(spark, d), key_date=KEY_DATE, limit=limit, seen=seen, item="doc_id").select(
        "slug", "doc_id", "upvotes", "topic_score", F.col("topic_score_parts.relevance").alias("relevance"), F.col("topic_score_parts.freshness").alias("freshness"), F.col("topic_score_parts.votes").alias("vote_part"), "source", "rank"
    )


def topic_rank(spark, d):
    return _ranked(spark, d, PROFILES[:1], 20)


def topic_rank_unseen(spark, d):
    seen = load(spark, d, "labels").filter("quality = 1").select("doc_id")
    return _ranked(spark, d, PROFILES[:1], 20, seen)


def multi_topic_rank(spark, d):
    return _ranked(spark, d, PROFILES, 3)


def freshness_decay(spark, d):
    rows = candidates(spark, d)
    return rows.select("doc_id", "submitted", F.round(freshness("submitted", F.lit(KEY_DATE).cast("date")), 6).alias("freshness"))


def slugify(spark, d):
    return candidates(spark, d).select("doc_id", slug("title").alias("slug"))


def search(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.col("text").alias("search_text"))
    return S.search(rows, " The That ", order="doc_id").select("doc_id", F.length("search_text").cast("long").alias("n_chars"))


def search_snapshot(spark, d):
    entries = all_boards(load(spark, d, "events")).withColumnRenamed("user_id", "doc_id")
    order = F.concat_ws("|", F.when(F.col("mode") == "daily", "0").when(F.col("mode") == "weekly", "1").otherwise("2"), "key")
    rows = entries.select("doc_id", order.alias("ord"), F.concat_ws(":", "mode", "key").alias("place"))
    texts = load(spark, d, "documents").select("doc_id", F.lower("text").alias("search_text"))
    out = S.snapshot(rows, texts, "doc_id")
    return out.select("doc_id", "first_place", F.size("places").cast("long").alias("n_places"), "note", F.length("search_text").cast("long").alias("text_chars"))


def _hit_sql(term: str) -> str:
    import re

    term = term.lower().strip()
    parts = [t for t in re.split(r"[^a-z0-9]+", term) if len(t) > 2]
    share = " + ".join(f"contains(t, '{p}')::INTEGER" for p in parts)
    return f"CASE WHEN contains(t, '{term}') THEN 1.0 ELSE {f'({share}) / {len(parts)}.0' if parts else '0.0'} END"


def _profile_sql(p: dict, limit: int, unseen: bool) -> str:
    x = R.normal_profile(p)
    must = x["must"] or [x["query"]]
    total = " + ".join([*(f"2.0 * ({_hit_sql(t)})" for t in must), *(f"({_hit_sql(t)})" for t in x["should"])])
    weight = max(1.0, 2.0 * len(must) + len(x["should"]))
    bad = " OR ".join(f"({_hit_sql(t)}) >= 1.0" for t in x["negative"]) or "FALSE"
    allowed = f"(lang IN {tuple(x['categories'])} OR source IN {tuple(x['categories'])})" if x["categories"] else "TRUE"
    w = x["weights"]
    return f"""
SELECT '{x["slug"]}' AS slug, doc_id, upvotes, topic_score, round(rel, 4) AS relevance, round(fresh, 4) AS freshness, round(vote, 4) AS vote_part,
  CASE WHEN upvotes > 0 THEN 'arxiv+hf' ELSE 'arxiv' END AS source, rank FROM (
  SELECT *, row_number() OVER (ORDER BY topic_score DESC, upvotes DESC, submitted DESC NULLS LAST, doc_id) AS rank FROM (
    SELECT *, round({w["relevance"]!r}::DOUBLE * rel + {w["freshness"]!r}::DOUBLE * fresh + {w["votes"]!r}::DOUBLE * vote, 4) AS topic_score FROM (
      SELECT doc_id, submitted, upvotes, CASE WHEN {bad} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({total})::DOUBLE / {weight}::DOUBLE) END AS rel, fresh,
        ln(1 + upvotes::DOUBLE) / ln(1 + most::DOUBLE) AS vote
      FROM scored WHERE {allowed} {"AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)" if unseen else ""}
    ) WHERE rel > 0
  )
) WHERE rank <= {limit}"""


_FRESH_SQL = f"CASE WHEN submitted IS NULL THEN 0.2::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - greatest(DATE '{KEY_DATE}' - submitted::DATE, 0) / 30.0::DOUBLE) END"
_SCORED_SQL = f"""
WITH {CANDIDATES_SQL}, {VOTES_SQL},
recent AS (SELECT * FROM candidates WHERE submitted IS NULL OR submitted::DATE >= DATE '{KEY_DATE}' - {DAYS}),
voted AS (SELECT recent.*, coalesce(votes, 0) AS upvotes FROM recent LEFT JOIN votes USING (doc_id)),
scored AS (SELECT *, greatest(max(upvotes) OVER (), 1) AS most, {_FRESH_SQL} AS fresh FROM voted)
"""

QUERIES = {
    "topic_rank": topic_rank,
    "topic_rank_unseen": topic_rank_unseen,
    "multi_topic_rank": multi_topic_rank,
    "freshness_decay": freshness_decay,
    "slugify": slugify,
    "search": search,
    "search_snapshot": search_snapshot,
}

ORACLE_SQL = {
    "topic_rank": _SCORED_SQL + _profile_sql(PROFILES[0], 20, False),
    "topic_rank_unseen": _SCORED_SQL + _profile_sql(PROFILES[0], 20, True),
    "multi_topic_rank": _SCORED_SQL + " UNION ALL ".join(f"({_profile_sql(p, 3, False)})" for p in PROFILES),
    "freshness_decay": f"WITH {CANDIDATES_SQL} SELECT doc_id, submitted, round({_FRESH_SQL}, 6) AS freshness FROM candidates",
    "slugify": f"""
WITH {CANDIDATES_SQL}, s AS (
  SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-'), 60) AS slug FROM candidates
) SELECT doc_id, CASE WHEN slug = '' THEN 'topic' ELSE slug END AS slug FROM s""",
    "search": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE contains(lower(text), 'the that') ORDER BY doc_id LIMIT 60",
    "search_snapshot": f"""
WITH e AS (
  SELECT user_id AS doc_id, CASE mode WHEN 'daily' THEN '0' WHEN 'weekly' THEN '1' ELSE '2' END || '|' || key AS ord, mode || ':' || key AS place FROM ({_ENTRIES_SQL})
), f AS (SELECT doc_id, list(place ORDER BY ord) AS places FROM e GROUP BY doc_id)
SELECT doc_id, places[1] AS first_place, len(places)::BIGINT AS n_places,
  array_to_string(places[1:3], ', ') || CASE WHEN len(places) > 3 THEN ' and ' || (len(places) - 3) || ' more' ELSE '' END AS note, length(lower(text)) AS text_chars
FROM f JOIN documents USING (doc_id)""",
}
