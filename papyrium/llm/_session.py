"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import BATCH_BYTES as BATCH_BYTES
from ..batches import bounded_batches

_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where the folder is shared (clusters use --py-files), and
    bounds the bytes of the session's Arrow batches, so that long texts don't add up in a batch."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *(p for p in paths if p)])
    return bounded_batches(spark)


_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where the setting is missing, a folder of this machine will do only if everything runs on it; on a
    cluster that raises, for what executors wrote there the others could not read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/papyrium-{os.getpid()}"
    return f"{root.rstrip('/')}/papyrium-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage, survives lost executors.

    Folders made here stay while results may still read them, until release() or the end of the driver.
    """
    spark = df.sparkSession
    if where is None:
        where = shared_dir(spark)
        _WRITTEN.append((spark, where))
    schema = df.schema
    df.write.mode("overwrite").parquet(where)
    return spark.read.schema(schema).parquet(where)


def release() -> int:
    """Deletes what written() has made so far, once no result needs it any more; how many folders."""
    gone = 0
    while _WRITTEN:
        spark, where = _WRITTEN.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            gone += bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))
        except (Py4JError, AttributeError, OSError):  # a session that has stopped
            continue
    return gone


atexit.register(release)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns of these names, in whatever case."""
    lower = {n.lower() for n in names}
    return df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in lower))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, name: str = "row"):
    """All columns of `df` as one struct, so that no name of a caller's column meets one of ours."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias(name) if df.columns else F.struct(F.lit(0).alias("none")).alias(name)


def beside(df: DataFrame, text_col: str) -> tuple[DataFrame, dict]:
    """`df` as a column `text` and a struct `row` of all others; and the columns that restore it, by name."""
    rest = df.select(*(F.col(quoted(c)) for c in df.columns if c != text_col))
    out = {c: (F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns}
    return df.select(packed(rest), F.col(quoted(text_col)).alias("text")), out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
