"""Topic ranking: candidates scored by term relevance, freshness and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import freshness
from ..functions.text import search_text, slug, term_hit

WEIGHTS = {"relevance": 0.45, "freshness": 0.30, "votes": 0.25}


def normal_profile(profile: dict) -> dict:
    """Defaults for what a profile leaves out; its weights overlay the default ones."""
    terms = profile.get("generated_terms") or {}
    query = (profile.get("query") or "").strip()
    name = (profile.get("display_name") or query).strip()
    return {
        "slug": profile.get("slug") or query.lower().replace(" ", "-"),
        "query": query,
        "display_name": name,
        "enabled": profile.get("enabled", True),
        "must": list(terms.get("must") or []),
        "should": list(terms.get("should") or []),
        "negative": list(terms.get("negative") or []),
        "categories": list(profile.get("categories") or []),
        "weights": {**WEIGHTS, **(profile.get("weights") or {})},
    }


def profile_table(spark, profiles: list[dict]) -> DataFrame:
    """Profiles as a table with nested terms and weights."""
    rows = [normal_profile(p) for p in profiles]
    schema = "slug string, query string, display_name string, enabled boolean, must array<string>, should array<string>, negative array<string>, categories array<string>, weights struct<relevance: double, freshness: double, votes: double>"
    return spark.createDataFrame([{**r, "weights": tuple(float(r["weights"][k]) for k in WEIGHTS)} for r in rows], schema)


def merged_terms(hints: Column, generated: Column, negative: Column | None = None, limit: int = 16) -> Column:
    """Hints, then generated terms: distinct without regard to case, first kept, none that conflicts
    with a negative term, `limit` at most."""
    both = F.filter(F.transform(F.concat(F.coalesce(hints, F.array().cast("array<string>")), F.coalesce(generated, F.array().cast("array<string>"))), lambda t: F.regexp_replace(F.trim(t), r"\s+", " ")), lambda t: F.length(t) > 0)
    low = F.transform(both, lambda t: F.lower(t))
    distinct = F.filter(both, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    if negative is not None:
        distinct = F.filter(distinct, lambda t: ~F.exists(negative, lambda n: conflicts(t, n)))
    return F.slice(distinct, 1, limit)


def conflicts(term: Column, negative: Column) -> Column:
    """Equal, the negative within the term, or a longer phrase of several words within the negative."""
    t, n = F.lower(F.trim(term)), F.lower(F.trim(negative))
    return (t == n) | F.contains(t, n) | (F.contains(t, F.lit(" ")) & (F.length(t) > 5) & F.contains(n, t))


def relevance(text: Column, must: Column, should: Column, negative: Column, query: Column) -> Column:
    """Weighted share of the terms that the text holds; 0 if it holds a negative term whole."""
    must = F.when(F.size(must) > 0, must).otherwise(F.array(query))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + term_hit(text, t))
    weight = F.greatest(F.lit(1.0), 2.0 * F.size(must) + F.size(should))
    score = F.least(F.lit(1.0), (2.0 * total(must) + total(should)) / weight)
    return F.when(F.exists(negative, lambda t: term_hit(text, t) >= 1.0), 0.0).otherwise(score)


def fresh_candidates(candidates: DataFrame, key_date: str, days: int, *, item: str = "arxiv_id", submitted: str = "submitted", order: str | None = None) -> DataFrame:
    """Candidates of the last `days` days and those whose date can't be read; of equal ids the first."""
    day = F.try_to_date(F.col(submitted).cast("string"), "yyyy-MM-dd")
    kept = candidates.filter(day.isNull() | (day >= F.date_sub(F.to_date(F.lit(key_date)), days)))
    if order is None:
        return kept.dropDuplicates([item])
    w = Window.partitionBy(item).orderBy(order)
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank_candidates(
    candidates: DataFrame, profiles: DataFrame, votes: DataFrame, *, key_date: str, limit: int = 3, seen: DataFrame | None = None, force: bool = False,
    item: str = "arxiv_id", title: str = "title", abstract: str = "abstract", categories: str = "categories", submitted: str = "submitted", window_days: int = 30,
) -> DataFrame:
    """The first `limit` candidates of each profile: slug, item, upvotes, topic_score, its parts, source
    and rank.

    votes: item and votes; missing ones are 0, the largest over all candidates scales them. seen: slug
    and item, left out unless `force`. Order: rounded score, votes, date (latest first, unknown last),
    then the item. Every candidate meets every profile that allows its categories, so the join has no key: the
    planner broadcasts the profiles while their measured size is small.
    """
    voted = candidates.join(votes.select(F.col(item), F.coalesce("votes", F.lit(0)).alias("upvotes")), item, "left").withColumn("upvotes", F.coalesce("upvotes", F.lit(0)))
    top = voted.agg(F.greatest(F.max("upvotes"), F.lit(1)).alias("_most"))
    rows = voted.withColumn("_text", search_text(title, abstract, categories)).join(F.broadcast(top))
    own = profiles.select("slug", "query", "must", "should", "negative", F.col("categories").alias("_allowed"), "weights")
    rows = rows.join(own, (F.size("_allowed") == 0) | F.arrays_overlap(F.col(categories), F.col("_allowed")))
    if seen is not None and not force:
        keys = [c for c in ("slug", item) if c in seen.columns]
        rows = rows.join(seen.select(*keys).distinct(), keys, "left_anti")
    scored = rows.withColumn("_rel", relevance(F.col("_text"), F.col("must"), F.col("should"), F.col("negative"), F.col("query"))).filter("_rel > 0")
    fresh = freshness(submitted, F.to_date(F.lit(key_date)), window_days)
    vote = F.log1p(F.col("upvotes").cast("double")) / F.log1p(F.col("_most").cast("double"))
    scored = scored.withColumns({"_fresh": fresh, "_vote": vote})
    total = F.col("weights.relevance") * F.col("_rel") + F.col("weights.freshness") * F.col("_fresh") + F.col("weights.votes") * F.col("_vote")
    scored = scored.withColumn("topic_score", F.round(total, 4))
    w = Window.partitionBy("slug").orderBy(F.desc("topic_score"), F.desc("upvotes"), F.desc_nulls_last(submitted), F.asc(item))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    parts = F.struct(F.round("_rel", 4).alias("relevance"), F.round("_fresh", 4).alias("freshness"), F.round("_vote", 4).alias("votes"))
    return ranked.select("slug", item, "upvotes", "topic_score", parts.alias("topic_score_parts"), F.when(F.col("upvotes") > 0, "arxiv+hf").otherwise("arxiv").alias("source"), "rank")


def topic_slug(query) -> Column:
    return slug(query)
