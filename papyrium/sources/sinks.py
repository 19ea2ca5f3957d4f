"""Sinks: slim indexes, partitioned tables and keyed merges that never overwrite what they read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.reconcile import upsert

SLIM = ("arxiv_id", "rank", "upvotes", "pdf_failed", "topic_score", "source")


def slim_indexes(entries: DataFrame, generated_at: str) -> DataFrame:
    """A row an index: mode, key, generated_at, total and its papers by rank, with a status from their flags."""
    status = F.when(F.coalesce("pdf_failed", F.lit(False)), "failed").otherwise(F.col("pdf_status") if "pdf_status" in entries.columns else F.lit(None).cast("string"))
    fields = [F.col(c) for c in SLIM if c in entries.columns]
    paper = F.struct(F.col("rank").alias("_order"), *fields, status.alias("pdf_status"))
    rows = entries.groupBy("mode", "key").agg(F.array_sort(F.collect_list(paper)).alias("papers"), F.count(F.lit(1)).alias("total"))
    keep = [c for c in SLIM if c in entries.columns] + ["pdf_status"]
    slim = F.transform("papers", lambda p: F.struct(*(p[c].alias(c) for c in keep)))
    return rows.select("mode", "key", F.lit(generated_at).alias("generated_at"), "total", slim.alias("papers"))


def write_indexes(indexes: DataFrame, root: str) -> None:
    """JSON partitioned by mode and key; only the partitions that are written are replaced."""
    indexes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "key").json(root)


def replace_table(df: DataFrame, root: str) -> DataFrame:
    """Writes a new version of a table beside the old one and returns it; readers of the old one go on.

    The caller points its catalogue at the new folder: a path is never overwritten while it is read.
    """
    where = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def merge_table(store: DataFrame, changes: DataFrame, key: str, root: str, create: bool = True) -> DataFrame:
    """A keyed field merge into a new version of the table."""
    return replace_table(upsert(store, changes, key, create), root)


def insert_first(index: DataFrame, row: DataFrame, key: str = "arxiv_id", pos: str = "pos") -> DataFrame:
    """A manual insert: the row takes the place of an equal id, else comes first."""
    known = index.select(key, F.col(pos).alias("_at"))
    both = row.join(known, key, "left")
    # Only rows that come in anew are numbered, and the others move by how many there are.
    fresh = both.filter("_at IS NULL").withColumn(pos, F.row_number().over(Window.orderBy(key)) - 1)
    moved = fresh.agg(F.count(F.lit(1)).alias("_more"))
    placed = both.filter("_at IS NOT NULL").withColumn(pos, F.col("_at")).select(*index.columns)
    rest = index.join(row.select(key), key, "left_anti").unionByName(placed).crossJoin(F.broadcast(moved))
    kind = index.schema[pos].dataType
    rest = rest.withColumn(pos, (F.col(pos) + F.col("_more")).cast(kind)).select(*index.columns)
    return rest.unionByName(fresh.withColumn(pos, F.col(pos).cast(kind)).select(*index.columns))


def delete_paper(index: DataFrame, others: DataFrame, files: DataFrame, arxiv_id: str, scan_errors: int, key: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """The index without the paper, and the files that may go: none while another index refers to the
    paper or any index couldn't be read."""
    kept = index.filter(F.col(key) != arxiv_id)
    if scan_errors:
        return kept, files.limit(0)
    return kept, files.filter(F.col(key) == arxiv_id).join(others.select(key).distinct(), key, "left_anti")


def append_history(history: DataFrame | None, run: DataFrame, key: str = "key", at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """All runs with the new one, and the latest run of each key."""
    every = run if history is None else history.unionByName(run, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return every, every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def enqueue(jobs: DataFrame, requests: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Jobs with the requests that may be queued: absent ones and those that ended in an error or without a PDF."""
    busy = jobs.filter(~F.col("status").isin("error", "done_no_pdf"))
    new = requests.dropDuplicates([key]).join(busy.select(key), key, "left_anti").withColumn("status", F.lit("queued"))
    return jobs.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def recover_jobs(jobs: DataFrame, stuck=("queued", "running", "translating", "compiling")) -> DataFrame:
    """Jobs that a dead worker left behind, set back to an error."""
    hit = F.col("status").isin(*stuck)
    return jobs.withColumn("status", F.when(hit, "error").otherwise(F.col("status")))


def queue_failures(failures: DataFrame, references: DataFrame, store: DataFrame, key: str = "arxiv_id") -> dict[str, DataFrame]:
    """The tables that a batch of quality failures changes, after all checks: references set to failed, tainted
    store rows, sidecars and counts by category. Raises if a failure has no store row or unknown category."""
    from ..functions.failures import PRIORITIES, priority
    from ..operators.audit import require_clean
    from ..operators.reconcile import arg_max

    known = F.col("category").isin(*PRIORITIES)
    require_clean(failures, ~F.coalesce(known, F.lit(False)), "categories")
    require_clean(failures.join(store.select(key), key, "left_anti"), F.lit(True), "stores")
    best = arg_max(failures.withColumn("_p", priority("category")), key, "_p", "pos").drop("_p")
    marked = best.select(key, F.col("category").alias("_category"))
    refs = references.join(marked, key).withColumn("pdf_status", F.lit("failed")).drop("_category")
    stronger = priority(F.col("_category")) >= priority(F.coalesce("pdf_quality_taint_reason", F.lit("")))
    tainted = store.join(marked, key).withColumns({"pdf_quality_tainted": F.lit(True), "pdf_quality_taint_reason": F.when(stronger, F.col("_category")).otherwise(F.col("pdf_quality_taint_reason")), "pdf_status": F.lit("failed")}).drop("_category")
    return {"references": refs, "store": tainted, "sidecars": best, "counts": best.groupBy("category").agg(F.count(F.lit(1)).alias("queued"))}


def move_bookmark(bookmarks: DataFrame, arxiv_id: str, source: str, target: str) -> DataFrame:
    """A paper moved to another list; nothing changes if it is there already."""
    there = bookmarks.filter((F.col("list_id") == target) & (F.col("arxiv_id") == arxiv_id)).select(F.lit(True).alias("_there")).limit(1)
    both = bookmarks.join(there, how="left")
    hit = (F.col("list_id") == source) & (F.col("arxiv_id") == arxiv_id) & F.col("_there").isNull()
    return both.withColumn("list_id", F.when(hit, target).otherwise(F.col("list_id"))).drop("_there")


def toggle_bookmark(bookmarks: DataFrame, row: DataFrame) -> DataFrame:
    """The row removed where it stands, added where it doesn't."""
    keys = ["list_id", "arxiv_id"]
    return bookmarks.join(row.select(*keys), keys, "left_anti").unionByName(row.join(bookmarks.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def bookmark_lists(bookmarks: DataFrame, papers: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Bookmarks with their papers' fields; the list's size on every row."""
    n = bookmarks.groupBy("list_id").agg(F.count(F.lit(1)).alias("list_size"))
    return bookmarks.join(papers, key, "left").join(n, "list_id")
