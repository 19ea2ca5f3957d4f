"""Queries over conversations, chunks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunks import chunk_cap, split_chunks
from ..functions.text import NON_ASCII
from ..operators import conversations as C
from ..operators import markup as M
from ..operators.reconcile import multiset_difference
from .common import load


def _pairs(spark, d):
    return C.turn_pairs(load(spark, d, "conversations"))


def turn_pairs(spark, d):
    return _pairs(spark, d)


def response_gate(spark, d):
    return C.gate(_pairs(spark, d), NON_ASCII).select("conv_id", "turn", "reason")


def response_reasons(spark, d):
    return C.reason_counts(C.gate(_pairs(spark, d), NON_ASCII))


def token_multiset_diff(spark, d):
    pairs = _pairs(spark, d)
    words = lambda c: pairs.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return multiset_difference(words("source"), words("response"), ["conv_id", "turn"], "token")


def fuzzy_echo(spark, d):
    """Answers that repeat their question; compared with the next question too, which often does."""
    return C.echoes(_pairs(spark, d)).select("conv_id", "turn", "ratio")


def html_titles(spark, d):
    return M.page_fields(load(spark, d, "pages"))


def html_links_first(spark, d):
    return M.ordered_links(load(spark, d, "pages"))


def bounded_chunks(spark, d):
    """Chunks of each document within its cap, in order; together they are the text."""
    docs = load(spark, d, "documents").select("doc_id", "text", chunk_cap("text").alias("cap"))
    each = docs.select("doc_id", "cap", F.posexplode(split_chunks("text", "cap")).alias("pos", "chunk"))
    return each.select("doc_id", "pos", "cap", F.length("chunk").alias("size"), F.xxhash64("chunk").alias("chunk_hash"))


def env_stack(spark, d):
    """Depth of tags on the way through each page, and where it is deepest."""
    depth = M.nesting(load(spark, d, "pages"))
    return depth.groupBy("page_id").agg(F.count(F.lit(1)).alias("tags"), F.max("depth").alias("deepest"), F.sum(F.when(F.col("depth") < 0, 1).otherwise(0)).alias("below"))


def ref_resolution(spark, d):
    """Links that begin exactly one longer link of their page."""
    links = M.ordered_links(load(spark, d, "pages")).select("page_id", F.regexp_replace("href", "^/", "").alias("label"))
    refs = links.select("page_id", F.substring("label", 1, 3).alias("ref")).filter("length(ref) = 3").distinct()
    return M.resolve_references(refs, links, "page_id")


QUERIES = {
    "turn_pairs": turn_pairs,
    "response_gate": response_gate,
    "response_reasons": response_reasons,
    "token_multiset_diff": token_multiset_diff,
    "fuzzy_echo": fuzzy_echo,
    "html_titles": html_titles,
    "html_links_first": html_links_first,
    "bounded_chunks": bounded_chunks,
    "env_stack": env_stack,
    "ref_resolution": ref_resolution,
}

_PAIRS = """
WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS source, CASE WHEN next_role = 'assistant' THEN next_text END AS response FROM t WHERE role = 'user')"""


def _n(c: str, drop: str) -> str:
    return f"length(regexp_replace({c}, '{drop}', '', 'g'))"


def _balance(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(?m)^((?:[^%\\\\\\n]|\\\\.)*)%.*$', '\\1', 'g'), '\\\\.', '', 'g')"
    return f"({_n(bare, '[^{]')} - {_n(bare, '[^}]')})"


_GATE = f"""{_PAIRS}, g AS (
  SELECT conv_id, turn, CASE
    WHEN response IS NULL OR trim(response, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR contains(response, '429 Client Error') OR contains(response, 'Error code: 429') OR contains(response, 'insufficient_user_quota') THEN 'request_failed'
    WHEN {_balance("source")} <> {_balance("response")} THEN 'latex_brace_balance_mismatch'
    WHEN {_n("source", "[^A-Za-z]")} >= 40 AND len(regexp_extract_all(source, '[A-Za-z][A-Za-z-]{{2,}}')) >= 6 AND {_n("source", "[\\x00-\\x7F]")} < 8
      AND {_n("response", "[^A-Za-z]")} >= 24 AND {_n("response", "[\\x00-\\x7F]")} < 6 THEN 'untranslated'
    ELSE '' END AS reason FROM pairs)"""

ORACLE_SQL = {
    "turn_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "response_gate": f"{_GATE} SELECT conv_id, turn, reason FROM g",
    "response_reasons": f"{_GATE} SELECT reason, count(*) AS n FROM g GROUP BY reason",
    "token_multiset_diff": f"""{_PAIRS}, s AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(source), '[a-z]+')) AS token FROM pairs) GROUP BY ALL),
r AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(response, '')), '[a-z]+')) AS token FROM pairs) GROUP BY ALL)
SELECT * FROM (SELECT conv_id, turn, token, greatest(coalesce(s.n, 0) - coalesce(r.n, 0), 0) AS left_only, greatest(coalesce(r.n, 0) - coalesce(s.n, 0), 0) AS right_only
  FROM s FULL JOIN r USING (conv_id, turn, token)) WHERE left_only > 0 OR right_only > 0""",
    "html_titles": """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title, lang, text_chars FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_chars FROM pages)""",
    "html_links_first": """
SELECT page_id, href, min(pos) - 1 AS first_pos FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages) GROUP BY ALL""",
    "env_stack": """
WITH e AS (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(/?(?:div|ul|article|nav|p))\\b', 1) AS x FROM pages)),
d AS (SELECT page_id, sum(CASE WHEN starts_with(tag, '/') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM e)
SELECT page_id, count(*) AS tags, max(depth)::BIGINT AS deepest, count(*) FILTER (WHERE depth < 0) AS below FROM d GROUP BY page_id""",
    "ref_resolution": """
WITH l AS (SELECT DISTINCT page_id, regexp_replace(href, '^/', '') AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)),
r AS (SELECT DISTINCT page_id, left(label, 3) AS ref FROM l WHERE length(label) >= 3),
u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page_id = r.page_id AND l.label = r.ref)),
f AS (SELECT u.page_id, ref, min(label) AS resolved FROM u JOIN l ON l.page_id = u.page_id AND starts_with(label, replace(ref, '/', ':')) GROUP BY ALL HAVING count(DISTINCT label) = 1)
SELECT page_id, ref, resolved FROM u LEFT JOIN f USING (page_id, ref)""",
}
