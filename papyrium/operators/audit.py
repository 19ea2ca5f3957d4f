"""Audits: one row for each defect, counts with zero classes, coverage and failure summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUES = ("missing_store", "failed_status", "tainted", "ok_missing_file", "bad_record")


def issues(items: DataFrame, store: DataFrame, key: str, size: str, min_size: int = 200) -> DataFrame:
    """key and issue: for each item every defect that its store row and its file (by size) show.

    store: key, status, tainted. An item without a store row, a failed status, a taint, and an ok status
    whose file is missing or too small are defects; one item may have several.
    """
    both = items.join(store.withColumn("_stored", F.lit(True)), key, "left")
    found = F.array(
        F.when(F.col("_stored").isNull(), "missing_store"),
        F.when(F.col("status") == "failed", "failed_status"),
        F.when(F.coalesce("tainted", F.lit(False)), "tainted"),
        F.when((F.col("status") == "ok") & (F.coalesce(size, F.lit(0)) < min_size), "ok_missing_file"),
    )
    return both.select(key, F.explode(F.array_compact(found)).alias("issue"))


def issue_counts(spark: SparkSession, found: DataFrame, key: str, names=ISSUES) -> DataFrame:
    """issue, n and distinct items, zero classes included."""
    known = spark.createDataFrame([(n,) for n in names], "issue string")
    counted = found.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("items"))
    return known.join(counted, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit(0)).alias("items"))


def total_mismatch(totals: DataFrame, declared: str = "declared", actual: str = "actual") -> DataFrame:
    """Rows with `mismatch`: a missing declared total is one."""
    return totals.withColumn("mismatch", ~F.col(declared).eqNullSafe(F.col(actual)))


def stats_by_mode(references: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Distinct ids of each mode, and of those the candidates, repaired and residual ones."""
    both = references.join(flags, key, "left")
    n = lambda c: F.countDistinct(F.when(F.col(c), F.col(key)))
    return both.groupBy("mode").agg(F.countDistinct(key).alias("ids"), n("candidate").alias("candidates"), n("repaired").alias("repaired"), n("residual").alias("residual"))


def coverage(items: DataFrame, covered: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Items with and without a partner, and the share of those with one, by group."""
    both = items.join(covered.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    total, hit = F.count(F.lit(1)), F.count("_hit")
    return both.groupBy(*by).agg(total.alias("total"), hit.alias("covered"), (total - hit).alias("uncovered"), F.round(100.0 * hit / F.greatest(total, F.lit(1)), 1).alias("pct"))


def failure_summary(records: DataFrame) -> DataFrame:
    """Counts by category, by retry strategy and in all, in one pass."""
    return records.groupingSets([["category"], ["retry_strategy"], []], "category", "retry_strategy").agg(F.count(F.lit(1)).alias("n"))


def patch_plan(records: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """A row for each category that the catalog knows: its patch, where it was seen first and how often."""
    counted = records.groupBy("category").agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n"))
    return counted.join(catalog, "category")


def require_clean(df: DataFrame, bad, what: str) -> DataFrame:
    """`df` itself if no row is bad; raises before anything is written otherwise."""
    found = df.filter(bad).limit(1).count()
    if found:
        raise ValueError(f"{what}: a row failed its check; nothing was written")
    return df
