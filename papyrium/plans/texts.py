"""Queries over text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NON_ASCII
from ..operators import quality as Q
from ..operators.contained import contained
from ..operators.paged import classify_pages, paged_report
from .common import load


def _lines(spark, d):
    return Q.line_flags(Q.lines(load(spark, d, "documents")), NON_ASCII)


def script_metrics(spark, d):
    return Q.script_metrics(load(spark, d, "documents"), script=NON_ASCII)


def script_pct_bins(spark, d):
    docs = load(spark, d, "documents")
    pct = Q.script_share("text", NON_ASCII)
    return docs.select("lang", Q.share_bin(pct).alias("bin")).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))


def word_line_bins(spark, d):
    return _lines(spark, d).filter("words >= 8").select(Q.word_bin(F.col("words")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def line_length_profile(spark, d):
    rows = Q.lines(load(spark, d, "documents"), keep=["lang"]).select("lang", F.length("line").alias("size"))
    return Q.length_profile(rows, ["lang"], "size")


def top_tokens(spark, d):
    return Q.top_tokens(load(spark, d, "documents"), ["lang"])


def doc_quality_report(spark, d):
    return Q.document_report(_lines(spark, d))


def doc_quality_flagged(spark, d):
    return doc_quality_report(spark, d).select("doc_id", Q.is_untranslated().alias("flagged"))


def longest_run(spark, d):
    return Q.longest_run(_lines(spark, d), "broad")


def strongest_run(spark, d):
    return Q.strongest_run(_lines(spark, d), "broad")


_MARK = r"(?i)licensed under|copyright"


def section_carry(spark, d):
    """Lines after a marker line belong to its section until the next marker."""
    marker = F.when(F.col("line").rlike(r"(?i)licensed under"), "license").when(F.col("line").rlike(r"^(The|La|El|Der|Die)(\W|$)"), "body")
    carried = Q.carry_state(Q.lines(load(spark, d, "documents")).withColumn("marker", marker), "marker")
    return carried.groupBy(F.coalesce("state", F.lit("front")).alias("state")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))


def line_context(spark, d):
    flagged = Q.lines(load(spark, d, "documents")).withColumn("flag", F.col("line").rlike(r"(?i)licensed under|token ="))
    return Q.line_context(flagged, "flag")


def worst_docs(spark, d):
    """The thirty documents with most long foreign lines."""
    report = doc_quality_report(spark, d)
    return report.orderBy(F.desc("broad_english"), F.asc("cjk_pct"), F.asc("doc_id")).limit(30).select("doc_id", "broad_english", "cjk_pct")


def line_samples(spark, d):
    flagged = _lines(spark, d).filter("very_long")
    return Q.first_samples(flagged, ["doc_id"], "pos", "line").select("doc_id", F.array_join("samples", "|").alias("samples"))


def paged_quality(spark, d):
    """Documents as paged texts, ten lines a page: classes of their pages and the verdict."""
    steps = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 10).cast("int"))
    paged = F.array_join(F.transform(steps, lambda i: F.array_join(F.slice("lines", i * 10 + 1, F.lit(10)), "\n")), "\f")
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines")).select("doc_id", paged.alias("text"))
    return paged_report(classify_pages(docs, "doc_id", "text", NON_ASCII), "doc_id")


def contained_passages(spark, d):
    """Benchmark items whose whole text stands in a document."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return contained(docs, load(spark, d, "benchmark"), "doc_id", "item_id", "text")


_LINES = """
l AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (
  SELECT *, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g')) AS cjk,
    len(regexp_extract_all(line, '[A-Za-z][A-Za-z-]{2,}')) AS words FROM l
), f AS (
  SELECT *, letters >= 40 OR cjk >= 10 AS prose, words >= 8 AND letters >= 50 AS broad, words >= 8 AND letters >= 50 AND cjk >= 8 AS mixed,
    words >= 8 AND letters >= 50 AND (cjk < 8 OR words >= cjk) AS dominant, letters >= 80 AND cjk <= 5 AND words >= 12 AS long,
    letters >= 180 AND cjk <= 8 AND words >= 24 AS very_long FROM m
)"""
_REPORT = f"""
WITH {_LINES}, r AS (
  SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE prose) AS prose_lines, count(*) FILTER (WHERE broad) AS broad_english,
    count(*) FILTER (WHERE mixed) AS mixed_language, count(*) FILTER (WHERE dominant) AS english_dominant, count(*) FILTER (WHERE long) AS long_english,
    count(*) FILTER (WHERE very_long) AS very_long_english, sum(letters)::BIGINT AS letters, sum(cjk)::BIGINT AS cjk,
    round(100.0 * sum(cjk)::DOUBLE / greatest(sum(cjk) + sum(letters), 1)::DOUBLE, 1) AS cjk_pct FROM f GROUP BY doc_id
)"""
_RUNS = f"""
WITH {_LINES}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f WHERE broad),
runs AS (SELECT doc_id, run, count(*) AS run_lines, sum(words)::BIGINT AS run_words, min(pos) AS run_start FROM g GROUP BY doc_id, run)"""
_COUNTS = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))"
_PCT = f"100.0 * {_COUNTS[1]}::DOUBLE / greatest({_COUNTS[0]} + {_COUNTS[1]}, 1)::DOUBLE"

QUERIES = {
    "script_metrics": script_metrics,
    "script_pct_bins": script_pct_bins,
    "word_line_bins": word_line_bins,
    "line_length_profile": line_length_profile,
    "top_tokens": top_tokens,
    "doc_quality_report": doc_quality_report,
    "doc_quality_flagged": doc_quality_flagged,
    "longest_run": longest_run,
    "strongest_run": strongest_run,
    "section_carry": section_carry,
    "line_context": line_context,
    "worst_docs": worst_docs,
    "line_samples": line_samples,
    "paged_quality": paged_quality,
    "contained_passages": contained_passages,
}

ORACLE_SQL = {
    "script_metrics": f"SELECT doc_id, {_COUNTS[0]}::BIGINT AS letters, {_COUNTS[1]}::BIGINT AS script_chars, len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{{2,}}'))::BIGINT AS tokens, round({_PCT}, 1) AS script_pct FROM documents",
    "script_pct_bins": f"""
SELECT lang, CASE WHEN p < 20 THEN '<20' WHEN p < 40 THEN '20-39' WHEN p < 60 THEN '40-59' WHEN p < 80 THEN '60-79' ELSE '80+' END AS bin, count(*) AS n
FROM (SELECT lang, {_PCT} AS p FROM documents) GROUP BY ALL""",
    "word_line_bins": f"WITH {_LINES} SELECT CASE WHEN words <= 15 THEN '8-15' WHEN words <= 30 THEN '16-30' ELSE '31+' END AS bin, count(*) AS n FROM f WHERE words >= 8 GROUP BY 1",
    "line_length_profile": f"""
WITH {_LINES}, s AS (SELECT lang, list(length(line) ORDER BY length(line)) AS x FROM l GROUP BY lang)
SELECT lang, len(x)::BIGINT AS n, x[1]::INTEGER AS min_len, list_median(x)::DOUBLE AS median_len, x[floor((len(x) - 1) * 0.9)::INTEGER + 1]::INTEGER AS p90_len, x[len(x)]::INTEGER AS max_len,
  len(list_filter(x, lambda v: v < 80))::BIGINT AS under_80, len(list_filter(x, lambda v: v < 160))::BIGINT AS under_160 FROM s""",
    "top_tokens": """
SELECT lang, token, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM (
    SELECT lang, lower(t) AS token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{2,}')) AS t FROM documents) GROUP BY ALL)
) WHERE rank <= 50""",
    "doc_quality_report": f"{_REPORT} SELECT * FROM r",
    "doc_quality_flagged": f"""{_REPORT}
SELECT doc_id, long_english >= 20 OR very_long_english >= 3 OR (long_english >= 10 AND cjk_pct < 70) OR (long_english >= 6 AND cjk_pct < 55)
  OR (cjk_pct < 45 AND long_english >= 4) OR (cjk_pct < 15 AND prose_lines >= 20) AS flagged FROM r""",
    "longest_run": f"{_RUNS} SELECT doc_id, max(run_lines) AS longest_run FROM runs GROUP BY doc_id",
    "strongest_run": f"""{_RUNS}
SELECT doc_id, run_lines, run_words, run_start FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run_lines DESC, run_words DESC, run_start) AS n FROM runs) WHERE n = 1""",
    "section_carry": f"""
WITH {_LINES}, k AS (
  SELECT *, CASE WHEN regexp_matches(line, '(?i)licensed under') THEN 'license' WHEN regexp_matches(line, '^(The|La|El|Der|Die)(\\W|$)') THEN 'body' END AS marker FROM l
), c AS (SELECT doc_id, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'front') AS state FROM k)
SELECT state, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM c GROUP BY state""",
    "line_context": f"""
WITH {_LINES}, h AS (
  SELECT doc_id, pos, regexp_matches(line, '(?i)licensed under|token =') AS flag,
    string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l
), n AS (SELECT *, count(*) FILTER (WHERE flag) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hit FROM h)
SELECT doc_id, pos, hit, context FROM n WHERE flag AND hit <= 10""",
    "worst_docs": f"{_REPORT} SELECT doc_id, broad_english, cjk_pct FROM r ORDER BY broad_english DESC, cjk_pct, doc_id LIMIT 30",
    "line_samples": f"""
WITH {_LINES}, n AS (SELECT doc_id, pos, left(line, 220) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f WHERE very_long)
SELECT doc_id, string_agg(t, '|' ORDER BY pos) AS samples FROM n WHERE n <= 5 GROUP BY doc_id""",
    "contained_passages": "SELECT doc_id, item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)",
}
