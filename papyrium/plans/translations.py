"""Queries over translations: leftovers of the model, fields filled from TeX, splitter pages and their reports.

The test tables hold no translations: each is made of the whole text of a document, line by line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.artifacts import ARTIFACTS
from ..functions.backfill import backfilled
from ..functions.chunks import splitter_nodes
from ..functions.rewrites import strip_artifacts
from ..operators import chunk_reports as C
from .common import load
from .tex import _formed, _formed_sql, _quoted

#: Forms of lines: what stands before and after the line (None: the line isn't kept).
ARTIFACT_FORMS = [
    ("Certainly! 译文", ""), ("Below is the translated text in Chinese:", ""), ("", " Please share the text you want translated."), ('"translation": "a \\"b\\" c",', None),
    ('["one", "two \\\\ three"]', None), ("好的，请提供您需要翻译的英文部分。", "。"), ("x. Please provide the section you would like me to translate.", ""),
    ("as per your instructions. Please provide the text you want me to translate.", ""), ("", "抱歉，您提供的文本仅包含命令。"), ("LATEX COMMANDS HAVE BEEN KEPT INTACT as requested", ""),
    ("(Please provide the section you want translated.)", ""), ("近年来，迁移学习作为一种有效的方法被提出", ""), ("", "\\cite{mnih2015human}。"),
    ("Please provide the text to be put into Chinese", "。"), ("Below is an English academic paper section, translated into Chinese", ": "), ("请提供本文本", ""),
]
_MODULUS = 41


def artifact_strip(spark, d):
    """Whole texts with leftovers of a translation model in many of their lines, cleaned."""
    docs = load(spark, d, "documents").select("doc_id", _formed(ARTIFACT_FORMS, _MODULUS).alias("text"))
    done = docs.select("doc_id", strip_artifacts("text")["text"].alias("t"))
    return done.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("cleaned"))


def _plain(c):
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))


def translation_backfill(spark, d):
    """Abstract, summary and keywords of translations from TeX made of the whole text; some stand there already."""
    line, k = F.col("line"), F.col("doc_id")
    body = F.concat(F.lit("{\\scriptsize\\textbf{警告：机器 禁止移除或修改此警告。}} \\\\ 摘要 \\textbf{"), line, F.lit("}。 第二\\cite{a,b} \\href{http://x}{链接} \\url{u}！\n第三句？尾 {\\em b}"))
    body = F.when(k % 5 == 4, line).when(k % 5 == 3, F.concat(F.lit("无句号 "), line)).otherwise(body)
    keys = F.concat(F.lit("\\keywords{一词, "), F.substring(line, 1, 9), F.lit("；\\and 三词，,五 \\bf 词}"))
    rows = load(spark, d, "documents").select("doc_id", _plain(F.coalesce("text", F.lit(""))).alias("line")).select(
        "doc_id",
        F.when(k % 11 != 0, F.concat(F.lit("\\begin{abstract}"), body, F.lit("\\end{abstract} "), keys)).alias("tex"),
        F.when(k % 3 == 0, "已有摘要").when(k % 3 == 1, "only english").alias("abstract_zh"),
        F.when(k % 2 == 0, "").otherwise("已有").alias("summary_zh"),
        F.when(k % 7 == 0, F.array(F.lit("旧"))).when(k % 7 == 1, F.array().cast("array<string>")).alias("keywords_zh"),
    )
    shown = F.array_join("keywords_zh", "|").alias("keywords_zh")
    return backfilled(rows).select("doc_id", F.sha2("abstract_zh", 256).alias("abstract_sha256"), F.sha2("summary_zh", 256).alias("summary_sha256"), shown)


def _papers(spark, d):
    """A splitter's page of each document, a fragment a line, and a translation that leaves every other line as it is."""
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    coded = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    fragment = lambda x, i: F.concat(F.when(i % 4 == 3, "\\item ").when(i % 4 == 1, "\\textbf{a}<br/> ").otherwise(""), coded(x))
    page = lambda x, i: F.concat(F.lit('<p style="color:'), F.when(i % 3 == 2, "red").otherwise("black"), F.lit(';">#[1-2]'), fragment(x, i), F.lit("#</p>"))
    back = lambda x, i: F.when((F.col("doc_id") + i) % 2 == 0, F.regexp_replace(x, "[aeiou]", "译")).otherwise(F.concat(F.when(i % 4 == 3, "\\item ").otherwise(""), x))
    return docs.select("doc_id", splitter_nodes(F.array_join(F.transform("lines", page), "\n")).alias("nodes"), F.array_join(F.transform("lines", back), "\n").alias("translated"))


def unchanged_chunks(spark, d):
    """A report on every paper's chunks, the most unchanged first."""
    return C.most_unchanged(C.chunk_reports(_papers(spark, d)))


def chunk_totals(spark, d):
    return C.overall(C.chunk_reports(_papers(spark, d)))


def chunk_commands(spark, d):
    return C.head_commands(_papers(spark, d))


def _re2(pattern: str, inner: str) -> str:
    """One deletion in SQL, whose patterns know neither possessive runs nor looking ahead."""
    p = pattern.replace("*+", "*")
    ahead = p.find("(?=")
    return f"regexp_replace({inner}, {_quoted(p.replace('(?=', '(') if ahead >= 0 else p)}, {_quoted(chr(92) + '1' if ahead >= 0 else '')}, 'g')"


def _stripped(inner: str) -> str:
    for p in ARTIFACTS:
        inner = _re2(p, inner)
    return inner


_SAID = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' ')"
_FRAGMENTS = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
f AS (SELECT *, CASE WHEN i % 4 = 3 THEN '\item ' || raw WHEN i % 4 = 1 THEN '\textbf{a}' || chr(10) || ' ' || raw ELSE raw END AS fragment, i % 3 <> 2 AS given,
  CASE WHEN (doc_id + i) % 2 = 0 THEN regexp_replace(raw, '[aeiou]', '译', 'g') WHEN i % 4 = 3 THEN '\item ' || raw ELSE raw END AS back FROM l),
w AS (SELECT doc_id, string_agg(back, chr(10) ORDER BY i) AS translated FROM f GROUP BY doc_id),
c AS (SELECT f.*, trim(fragment, chr(32) || chr(9) || chr(10) || chr(13)) AS core, translated FROM f JOIN w USING (doc_id)),
u AS (SELECT *, regexp_replace(core, '\\[A-Za-z@]+\*?(\[[^\]]*\])?(\{[^{}]*\})?', ' ', 'g') AS said FROM c),
r AS (SELECT doc_id, count(*) AS total, count(*) FILTER (given) AS transform, count(*) FILTER (NOT given) AS preserve,
  coalesce(min(length(fragment)) FILTER (given), 0) AS min_len, coalesce(median(length(fragment)) FILTER (given), 0)::DOUBLE AS median_len,
  coalesce(max(length(fragment)) FILTER (given), 0) AS max_len, list_sort(list(length(fragment)) FILTER (given)) AS sizes,
  count(*) FILTER (given AND length(fragment) < 80) AS under_80, count(*) FILTER (given AND length(fragment) < 160) AS under_160,
  count(*) FILTER (given AND length(core) >= 30 AND length(regexp_replace(said, '[^A-Za-z]', '', 'g')) >= 18 AND contains(translated, core)) AS unchanged,
  count(*) FILTER (regexp_matches(regexp_replace(back, '\\[A-Za-z@]+\*?(\[[^\]]*\])?(\{[^{}]*\})?', ' ', 'g'), '([A-Za-z][A-Za-z-]{2,}[\s,.;:()]+){8}')) AS long_english_lines
  FROM u GROUP BY doc_id)"""

QUERIES = {
    "artifact_strip": artifact_strip,
    "translation_backfill": translation_backfill,
    "unchanged_chunks": unchanged_chunks,
    "chunk_totals": chunk_totals,
    "chunk_commands": chunk_commands,
}

ORACLE_SQL = {
    "artifact_strip": f"""
WITH {_formed_sql(ARTIFACT_FORMS, _MODULUS)}, w AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM t GROUP BY doc_id),
s AS (SELECT doc_id, {_stripped("text")} AS t FROM w)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS cleaned FROM s""",
    "translation_backfill": f"""
WITH s AS (SELECT doc_id, {_SAID} AS line FROM documents),
a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 3 THEN trim('无句号 ' || line, ' ') ELSE '摘要 ' || line || '。 第二 链接 u！ 第三句？尾 b' END AS found,
  '摘要 ' || line || '。第二 链接 u！' AS brief, trim(left(line, 9), ' ') AS word FROM s)
SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN '已有摘要' WHEN found IS NOT NULL THEN found WHEN doc_id % 3 = 1 THEN 'only english' END) AS abstract_sha256,
  sha256(CASE WHEN doc_id % 2 <> 0 THEN '已有' WHEN found IS NULL THEN '' WHEN doc_id % 5 = 3 THEN found ELSE brief END) AS summary_sha256,
  CASE WHEN doc_id % 7 = 0 THEN '旧' WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 7 = 1 THEN '' END ELSE '一词|' || CASE WHEN word = '' THEN '' ELSE word || '|' END || '三词|五 词' END AS keywords_zh FROM a""",
    "unchanged_chunks": f"WITH {_FRAGMENTS} SELECT * EXCLUDE (sizes), coalesce(sizes[1 + floor((len(sizes) - 1) * 0.9)::INTEGER], 0) AS p90_len FROM r",
    "chunk_totals": f"""
WITH {_FRAGMENTS}
SELECT count(*) AS papers, sum(transform)::BIGINT AS transform, sum(under_80)::BIGINT AS under_80, sum(under_160)::BIGINT AS under_160, sum(unchanged)::BIGINT AS unchanged,
  round(100.0::DOUBLE * sum(unchanged) / greatest(sum(transform), 1), 1) AS unchanged_pct FROM r""",
    "chunk_commands": f"""
WITH {_FRAGMENTS}, h AS (SELECT regexp_extract(fragment, '^\\s*\\\\([A-Za-z@]+)', 1) AS command FROM f WHERE given)
SELECT command, count(*) AS n FROM h WHERE command <> '' GROUP BY command""",
}
