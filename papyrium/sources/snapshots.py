"""Snapshots: results that are kept with what they were made of, and used again while that is unchanged and they are young."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, version string, made_at timestamp, sources string, state string"


def source_state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below the paths: names, sizes and times of change. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    each = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    # A sum of hashes doesn't depend on the order and is pre-aggregated.
    total = F.sum(F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)"))
    row = files.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).first()
    return f"{row['n']}:{row['total'] or 0}"


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{root}/manifest")
    except (AnalysisException, Py4JJavaError):  # no snapshot yet
        return None


def latest(spark: SparkSession, root: str, name: str):
    """The manifest of a name's latest snapshot, or None."""
    known = _manifests(spark, root)
    return None if known is None else known.filter(F.col("name") == name).orderBy(F.desc("made_at"), F.desc("version")).first()


def _note(spark: SparkSession, root: str, name: str, version: str, now: dt.datetime, sources: list[str], state: str) -> None:
    row = spark.createDataFrame([(name, version, now, "|".join(sources), state)], MANIFEST)
    row.coalesce(1).write.json(f"{root}/manifest/{uuid.uuid4().hex}")


def snapshot(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], sources: list[str], max_age: dt.timedelta, now: dt.datetime | None = None) -> DataFrame:
    """The result of build() as a table: the latest one while it is younger than `max_age` and its sources are
    unchanged, else a new version beside it.

    The manifest is written after the table, so that a run that dies leaves a version nobody reads. The state of the
    sources is taken before they are read: a change in between makes the next call build anew.
    """
    now = now or dt.datetime.now()
    state = source_state(spark, sources)
    last = latest(spark, root, name)
    if last and last["state"] == state and dt.timedelta(0) <= now - last["made_at"] < max_age:
        return spark.read.parquet(f"{root}/{name}/{last['version']}")
    version = f"v-{uuid.uuid4().hex}"
    build().write.parquet(f"{root}/{name}/{version}")
    _note(spark, root, name, version, now, sources, state)
    return spark.read.parquet(f"{root}/{name}/{version}")


def invalidate(spark: SparkSession, root: str, name: str, now: dt.datetime | None = None) -> None:
    """What a writer of a source calls: the next snapshot() builds anew, whatever the age."""
    _note(spark, root, name, "", now or dt.datetime.now(), [], "invalid")
