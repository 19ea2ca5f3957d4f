"""Appendix sections that hold source data: a label carried over pages until a heading of its rank or above ends it.

A heading whose title names source data (examples, prompts, instructions) opens a section under its label. It stays
open below headings of its own subsections and below any deeper one; another heading of the same or a higher rank ends it
(A.2 ends A.1 and A.1.3, not A). Two windows over the headings of a document do that: all headings from one opening to the next
are a group, and a running maximum tells whether one of them ended it. Nothing is folded in order by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A heading with its label, and titles of sections that are source data.
HEADING = r"(?m)^\s*([A-Z](?:\.\d+)*)\.?\s+([A-Z][^\n]{2,120})\s*$"
SOURCE_TITLE = (
    r"(?i)(?:\btask\s+examples?\b|\bin-domain\s+examples?\b|\bout-of-domain\s+examples?\b|\bdataset\s+taxonomy\s+and\s+examples?\b|\bmeta\s+prompts?\b"
    r"|\binstructions?\s+for\b|\bcase\s+stud(?:y|ies)\s+of\s+(?:scientific\s+)?(?:judge|thinker|model|agent)\b)"
)


def _rank(label: Column) -> Column:
    return F.char_length(label) - F.char_length(F.replace(label, F.lit("."), F.lit("")))


def headings(pages: DataFrame, key: str, pos: str = "pos", text: str = "line") -> DataFrame:
    """key, pos, nth (of the page), label, title and source (the title names source data) of each heading."""
    labels, titles = (F.regexp_extract_all(text, F.lit(HEADING), F.lit(i)) for i in (1, 2))
    each = pages.select(key, pos, F.posexplode(F.arrays_zip(labels.alias("label"), titles.alias("title"))).alias("nth", "_h"))
    return each.select(key, pos, "nth", "_h.label", "_h.title").withColumn("source", F.col("title").rlike(SOURCE_TITLE))


def open_sections(found: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """`found` with `open`: the label of the source section that is open after each heading, or null."""
    order = Window.partitionBy(key).orderBy(pos, "nth")
    grouped = found.withColumn("_group", F.sum(F.col("source").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(key, "_group").orderBy(pos, "nth").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.first(F.when(F.col("source"), F.col("label"))).over(group)
    marked = grouped.withColumn("_opened", opened)
    below = (F.col("label") == F.col("_opened")) | F.col("label").startswith(F.concat("_opened", F.lit(".")))
    ended = F.max((~below & (_rank(F.col("label")) <= _rank(F.col("_opened")))).cast("int")).over(group)
    return marked.withColumn("open", F.when(F.coalesce(ended, F.lit(0)) == 0, F.col("_opened"))).drop("_group", "_opened")


def page_sections(pages: DataFrame, key: str, pos: str = "pos", text: str = "line") -> DataFrame:
    """key, pos, before and after (labels open at the page's start and end, or null) and source of each page.

    A page is source data if a section is open at its start, or opens on it. Pages without a heading carry what is open
    on. Null text: no heading. Pages that repeat key and position are one page.
    """
    marked = open_sections(headings(pages, key, pos, text), key, pos)
    last = marked.groupBy(key, pos).agg(F.max_by(F.struct("open"), "nth").alias("_last"), F.max("open").isNotNull().alias("_any"))
    every = pages.select(key, pos).distinct().join(last, [key, pos], "left")
    order = Window.partitionBy(key).orderBy(pos)
    after = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = every.select(key, pos, before["open"].alias("before"), after["open"].alias("after"), F.coalesce("_any", F.lit(False)).alias("_any"))
    return out.withColumn("source", F.col("before").isNotNull() | F.col("_any")).drop("_any")
