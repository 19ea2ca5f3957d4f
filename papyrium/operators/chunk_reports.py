"""Reports on chunks of translated papers: what a splitter gave to translation and what came back unchanged.

All measures of a paper are array expressions over its own fragments: one pass over the rows, no shuffle but the
final sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from .quality import lower_percentile

# Commands with their arguments, a command at the head of a fragment, a long run of English.
COMMAND = r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
HEAD_COMMAND = r"^\s*\\([A-Za-z@]+)"
LONG_ENGLISH = r"(?:[A-Za-z][A-Za-z-]{2,}+[\s,.;:()]++){8}"
MIN_CHARS, MIN_LETTERS, MAX_SCRIPT = 30, 18, 4
_BLANK = " \t\n\r\f\u000b"


def _unchanged(core: Column, translated: Column) -> Column:
    said = F.regexp_replace(core, COMMAND, " ")
    return (
        (F.length(core) >= MIN_CHARS)
        & (F.regexp_count(said, F.lit("[A-Za-z]")) >= MIN_LETTERS)
        & (F.regexp_count(said, F.lit(CJK)) < MAX_SCRIPT)
        & F.contains(translated, core)
    )


def chunk_reports(papers: DataFrame, key: str = "doc_id", nodes: str = "nodes", translated: str = "translated") -> DataFrame:
    """A row a paper: fragments given to translation and kept, their lengths, those that stand unchanged in the
    translation, and its lines of long English.

    `nodes` is an array of (text, preserve). Null nodes or translations count as empty.
    """
    text = F.coalesce(F.col(translated), F.lit(""))
    given = F.transform(F.filter(nodes, lambda x: ~x["preserve"]), lambda x: x["text"])
    rows = papers.select(key, text.alias("_text"), F.coalesce(given, F.array().cast("array<string>")).alias("_given"), F.greatest(F.size(nodes), F.lit(0)).alias("total"))
    rows = rows.withColumn("_sizes", F.array_sort(F.transform("_given", F.length)))
    n = F.size("_given")
    mid = (F.element_at("_sizes", F.floor((n + 1) / 2).cast("int")) + F.element_at("_sizes", F.floor(n / 2).cast("int") + 1)) / 2.0
    below = lambda size: F.size(F.filter("_sizes", lambda x: x < size))
    cores = F.transform("_given", lambda x: F.btrim(x, F.lit(_BLANK)))
    english = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, COMMAND, " ").rlike(LONG_ENGLISH))
    return rows.select(
        key, "total", n.alias("transform"), (F.col("total") - n).alias("preserve"),
        F.coalesce(F.array_min("_sizes"), F.lit(0)).alias("min_len"), F.when(n > 0, mid).otherwise(0.0).alias("median_len"),
        lower_percentile(F.col("_sizes"), 0.9).alias("p90_len"), F.coalesce(F.array_max("_sizes"), F.lit(0)).alias("max_len"),
        below(80).alias("under_80"), below(160).alias("under_160"),
        F.size(F.filter(cores, lambda x: _unchanged(x, F.col("_text")))).alias("unchanged"), F.size(english).alias("long_english_lines"),
    )


def most_unchanged(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """All reports, those with the most unchanged fragments first; ties by key."""
    return reports.orderBy(F.desc("unchanged"), F.asc(key))


def overall(reports: DataFrame) -> DataFrame:
    """One row over all papers; the share of unchanged fragments in per cent."""
    sums = reports.agg(
        F.count(F.lit(1)).alias("papers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("transform", "under_80", "under_160", "unchanged")),
    )
    return sums.withColumn("unchanged_pct", F.round(100.0 * F.col("unchanged") / F.greatest("transform", F.lit(1)), 1))


def head_commands(papers: DataFrame, nodes: str = "nodes") -> DataFrame:
    """How many translated fragments begin with each command."""
    name = F.regexp_extract("node.text", HEAD_COMMAND, 1)
    given = papers.select(F.explode(nodes).alias("node")).filter(~F.col("node.preserve"))
    return given.select(name.alias("command")).filter("command <> ''").groupBy("command").agg(F.count(F.lit(1)).alias("n"))
