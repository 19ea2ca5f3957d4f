"""Search: a folded snapshot of all places of a paper, and substring search over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(entries: DataFrame, texts: DataFrame, key: str, order: str = "ord", place: str = "place", text: str = "search_text") -> DataFrame:
    """A row a paper: first place, all distinct places in order, a note of the first three and the text."""
    places = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, place))), lambda x: x[place]))
    folded = entries.groupBy(key).agg(F.min(order).alias("ord"), F.min_by(place, order).alias("first_place"), places.alias("places"))
    return folded.withColumn("note", note("places")).join(texts.select(key, text), key)


def note(places: str, shown: int = 3):
    """The first places and how many more."""
    c = F.col(places)
    return F.concat(F.array_join(F.slice(c, 1, shown), ", "), F.when(F.size(c) > shown, F.concat(F.lit(" and "), (F.size(c) - shown).cast("string"), F.lit(" more"))).otherwise(""))


def search(rows: DataFrame, query: str, *, text: str = "search_text", order: str = "ord", limit: int = 60) -> DataFrame:
    """The first `limit` rows whose text holds the query without regard to case; none for a blank query."""
    q = (query or "").strip().lower()
    if not q:
        return rows.limit(0)
    return rows.filter(F.contains(F.lower(F.col(text)), F.lit(q))).orderBy(order).limit(limit)
