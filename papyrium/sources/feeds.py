"""Feeds: Atom entries as candidates, the search predicate that a remote source takes, votes of boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

_ENTRY = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>, link array<struct<_href: string, _title: string>>"


def arxiv_id(url) -> Column:
    """The id in an abstract URL without its version, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/abs/(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def parse_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A candidate for each entry of each feed; entries without a readable id are dropped."""
    each = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit("(?s)<entry>.*?</entry>"), F.lit(0))).alias("entry"))
    rows = each.select(F.from_xml("entry", _ENTRY).alias("e")).select("e.*")
    blank = lambda c: F.coalesce(squeeze(c), F.lit(""))
    pdf = F.try_element_at(F.filter(F.coalesce("link", F.array().cast("array<struct<_href: string, _title: string>>")), lambda l: l["_title"] == "pdf"), F.lit(1))
    out = rows.select(
        arxiv_id("id").alias("arxiv_id"),
        blank("title").alias("title"),
        blank("summary").alias("abstract"),
        F.array_join(F.transform("author", lambda a: F.trim(a["name"])), ", ").alias("authors"),
        F.substring("published", 1, 10).alias("submitted"),
        F.col("id").alias("url"),
        pdf["_href"].alias("pdf_url"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
    )
    return out.filter("arxiv_id IS NOT NULL")


def search_query(categories: list[str], terms: list[str], limit: int = 16) -> str:
    """The predicate that a remote search takes: any category and any of at most `limit` distinct terms."""
    seen: dict[str, str] = {}
    for t in terms:
        t = " ".join((t or "").replace('"', " ").split())
        if t and t.lower() not in seen:
            seen[t.lower()] = t
    parts = []
    if categories:
        parts.append("(" + " OR ".join(f"cat:{c}" for c in categories) + ")")
    if seen:
        parts.append("(" + " OR ".join(f'all:"{t}"' for t in list(seen.values())[:limit]) + ")")
    return " AND ".join(parts)


def pushed_down(candidates: DataFrame, categories: list[str], terms: list[str], limit: int = 80) -> DataFrame:
    """The same predicate on a table: newest first, `limit` rows."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = F.lit(not terms)
    for t in terms[:16]:
        hit = hit | F.contains(text, F.lit(t.lower()))
    rows = candidates.filter(hit)
    if categories:
        rows = rows.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    return rows.orderBy(F.desc_nulls_last("submitted"), "arxiv_id").limit(limit)


def votes(boards: list[DataFrame], item: str = "arxiv_id", value: str = "upvotes") -> DataFrame:
    """The most votes of each item over several boards; null votes are 0."""
    out = None
    for b in boards:
        own = b.select(item, F.coalesce(value, F.lit(0)).alias("votes"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(item).agg(F.max("votes").alias("votes"))
