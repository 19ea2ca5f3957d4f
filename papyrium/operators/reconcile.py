"""Reconciliation of indexes, stores and files: overlays, status folds, gates, deltas and set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlay

#: Status precedence: failed over ok over none over absent.
STATUS_RANK = {"failed": 3, "ok": 2, "none": 1}


def merge_overlay(base: DataFrame, top: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All rows of `base`; each field from `top` where that has a non-empty value."""
    renamed = top.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    rest = [c for c in base.columns if c not in fields and c != key]
    return base.join(renamed, key, "left").select(key, *rest, *(overlay(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields))


def upsert(store: DataFrame, changes: DataFrame, key: str, create: bool = True) -> DataFrame:
    """A field-level merge: changed fields win where they are not null; new keys come in if `create`."""
    fields = [c for c in store.columns if c != key]
    own = changes.select(key, *((F.col(c) if c in changes.columns else F.lit(None).cast(store.schema[c].dataType)).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    both = store.withColumn("_own", F.lit(True)).join(own, key, "full_outer" if create else "left")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in fields))


def merge_fields(rows: DataFrame, updates: DataFrame, key: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with allowed fields updated where they differ, and one row of counts: changed, matched, missing."""
    own = updates.select(key, *(F.col(f).alias(f"_{f}") for f in allowed), F.lit(True).alias("_hit"))
    both = rows.join(own, key, "left")
    changed = F.lit(False)
    out = {}
    for f in allowed:
        differs = F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f))
        changed = changed | differs
        out[f] = F.when(differs, F.col(f"_{f}")).otherwise(F.col(f))
    merged = both.withColumn("_changed", changed)
    counts = merged.agg(F.sum(F.col("_changed").cast("long")).alias("changed"), F.sum(F.coalesce(F.col("_hit"), F.lit(False)).cast("long")).alias("matched"))
    missing = updates.join(rows.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return merged.withColumns(out).select(*rows.columns), counts.join(missing)


def status_rank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for name, r in STATUS_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def rank_status(c: Column) -> Column:
    out = F.lit("absent")
    for name, r in STATUS_RANK.items():
        out = F.when(c == r, name).otherwise(out)
    return out


def final_states(attempted: DataFrame, evidence: list[DataFrame], key: str, state: str = "state") -> DataFrame:
    """The state of each attempted key (a row each): that of the first table of `evidence` with a non-null one, else
    its own. Tables of evidence hold a key at most once; keys that nobody attempted are left out."""
    out = attempted.select(key, F.col(state).alias("_own"))
    for i, table in enumerate(evidence):
        out = out.join(table.select(key, F.col(state).alias(f"_s{i}")), key, "left")
    return out.select(key, F.coalesce(*(f"_s{i}" for i in range(len(evidence))), "_own").alias(state))


def state_counts(states: DataFrame, success: str, state: str = "state") -> DataFrame:
    """Keys by final state, and how many of them succeeded."""
    return states.groupBy(F.col(state).alias("final")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col(state) == success).alias("succeeded"))


def fold_status(evidence: DataFrame, key: str, status: str = "status") -> DataFrame:
    """One status an item: the one of highest precedence over all its rows."""
    return evidence.groupBy(key).agg(rank_status(F.max(status_rank(status))).alias(status))


def fan_out(references: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """The folded status on every reference of the item."""
    return references.join(folded, key, "left")


def publication_gate(items: DataFrame, evidence: DataFrame, key: str, blocked: str = "blocked") -> DataFrame:
    """Items with `blocked`: true if any of their evidence says so."""
    any_ = evidence.groupBy(key).agg(F.bool_or(F.coalesce(blocked, F.lit(False))).alias("blocked"))
    return items.join(any_, key, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def arg_max(rows: DataFrame, key: str, priority: str, pos: str) -> DataFrame:
    """Of each key the row of highest priority, the first one on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(priority), F.asc(pos))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_status(status: Column, tainted: Column, event: Column, file_valid: Column) -> Column:
    """The state machine of a paper: ok is refused while tainted, a taint forces failed, a verification
    clears it, a reconciliation turns failed into ok if the file is valid and untainted."""
    return (
        F.when(event == "taint", "failed")
        .when(event == "verify", F.when(file_valid, "ok").otherwise("failed"))
        .when(event == "set_ok", F.when(tainted, status).otherwise("ok"))
        .when(event == "reconcile", F.when((status == "failed") & file_valid & ~tainted, "ok").otherwise(status))
        .otherwise(status)
    )


def orphans(files: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return files.join(references.select(key).distinct(), key, "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """Items of each group with their surplus on the left and on the right."""
    count = lambda df, name: df.groupBy(*by, item).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "_l").join(count(right, "_r"), [*by, item], "full_outer")
    l, r = F.coalesce("_l", F.lit(0)), F.coalesce("_r", F.lit(0))
    out = both.select(*by, item, F.greatest(l - r, F.lit(0)).alias("left_only"), F.greatest(r - l, F.lit(0)).alias("right_only"))
    return out.filter("left_only > 0 OR right_only > 0")


def merge_counters(stats: DataFrame, by: list[str], counters: list[str], residual: str | None = None, audited: str | None = None) -> DataFrame:
    """Sums of counters; residual ids are united, less those that a later audit looked at and cleared."""
    out = stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counters))
    if not residual:
        return out
    # Ids are exploded and made distinct in parts; a group's array holds each once.
    ids = lambda c: stats.select(*by, F.explode(c).alias("_id")).distinct()
    left = ids(F.col(residual))
    if audited:
        left = left.join(ids(F.array_except(audited, residual)), [*by, "_id"], "left_anti")
    kind = stats.schema[residual].dataType.simpleString()
    named = left.groupBy(*by).agg(F.array_sort(F.collect_set("_id")).alias(residual))
    return out.join(named, by, "left").withColumn(residual, F.coalesce(residual, F.array().cast(kind)))


def reclaimable(files: DataFrame, references: DataFrame, key: str, modified: str, now: Column, grace_days: int = 3) -> DataFrame:
    """Files with their outcome: recent (within the grace time, whether referenced or not), referenced or removable."""
    from ..functions.calendar import in_grace

    held = references.select(key).distinct().withColumn("_held", F.lit(True))
    outcome = F.when(in_grace(modified, now, grace_days), "recent").when(F.col("_held"), "referenced").otherwise("removable")
    return files.join(held, key, "left").withColumn("outcome", outcome).drop("_held")


def reclaim_counts(plan: DataFrame, kind: str = "kind", size: str = "length") -> DataFrame:
    """By kind: files kept as recent or referenced, files that would go, and the bytes they hold."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    gone = F.coalesce(F.sum(F.when(F.col("outcome") == "removable", F.col(size))), F.lit(0))
    return plan.groupBy(kind).agg(count("recent").alias("kept_recent"), count("referenced").alias("kept_referenced"), count("removable").alias("would_remove"), gone.alias("would_free_bytes"))
