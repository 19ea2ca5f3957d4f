"""Repair campaigns: steps over what is left, written one by one, so that a run that dies goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step takes what is left and returns it with `repaired` (boolean): what it could do of it.
Step = Callable[[DataFrame], DataFrame]
REPORT = "round int, step string, attempted long, repaired long"


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    """A step's table, if it was written whole."""
    try:
        return spark.read.parquet(path) if spark.read.option("recursiveFileLookup", "true").text(f"{path}.done").limit(1).count() else None
    except AnalysisException:
        return None


def run(targets: DataFrame, key: str, steps: list[tuple[str, Step]], root: str, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """What is left after all steps, and the report: what each step of each round attempted and repaired.

    Targets that repeat a key are one. A step sees what those before it left; after the last a new round begins, until
    nothing is left, a round repaired nothing, or `rounds` are over. Each step's result is a table of its own below `root`,
    marked when it is whole; a later run with the same root reads marked steps and does the others, so that it ends as if
    it had never died. A step that raises ends the run; what stands before it stays.
    """
    spark = targets.sparkSession
    left, report = targets.dropDuplicates([key]), []
    for number in range(1, rounds + 1):
        progress = 0
        for name, step in steps:
            path = f"{root}/round={number}/{name}"
            result = _done(spark, path)
            if result is None:
                step(left).withColumn("repaired", F.coalesce("repaired", F.lit(False))).write.mode("overwrite").parquet(path)
                spark.range(1).select(F.lit(name)).coalesce(1).write.mode("overwrite").text(f"{path}.done")
                result = spark.read.parquet(path)
            counts = result.agg(F.count(F.lit(1)).alias("n"), F.count_if("repaired").alias("ok")).first()
            report.append((number, name, counts["n"], counts["ok"]))
            progress += counts["ok"]
            left = result.filter(~F.col("repaired")).drop("repaired")
            if counts["n"] == counts["ok"]:
                return left, spark.createDataFrame(report, REPORT)
        if not progress:
            break
    return left, spark.createDataFrame(report, REPORT)


def outcome(targets: DataFrame, left: DataFrame, key: str, by: list[str]) -> DataFrame:
    """By group: unique targets, repaired, residual and status (ok, or partial where something is left)."""
    rows = targets.dropDuplicates([key]).select(key, *by).join(left.select(key).withColumn("_left", F.lit(True)), key, "left")
    n = F.count_if(F.col("_left"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("targets"), n.alias("residual"))
    return sums.withColumn("repaired", F.col("targets") - F.col("residual")).withColumn("status", F.when(F.col("residual") > 0, "partial").otherwise("ok"))
