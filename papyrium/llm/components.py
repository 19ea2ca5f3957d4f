"""Connected components of a link table by alternating large-star and small-star steps.

Each step keeps the components and draws links towards small ids; about log(n) rounds lead to stars.
Links are never collected: minima are pre-aggregated, and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import written


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")))
    out = down.join(least, "a").select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
    return out.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest id reachable) for each end of a link (columns a and b).

    Links of a node to itself and links with a null end are dropped. Nodes without a link are absent.
    """
    now = written(links.filter("a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(rounds):
        now = written(_small(written(_large(now))))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
