"""What the query modules share: tables, and the paper columns that the test tables stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded_batches


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ranking candidates."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int"))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang", "source").alias("categories"),
        F.when(F.col("doc_id") % 37 != 0, F.date_format(day, "yyyy-MM-dd")).alias("submitted"),
    )


CANDIDATES_SQL = """
candidates AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS abstract, lang, source,
    lower(string_split(text, chr(10))[1] || ' ' || text || ' ' || lang || ' ' || source) AS t,
    CASE WHEN doc_id % 37 <> 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') END AS submitted
  FROM documents
)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("votes"))


VOTES_SQL = "votes AS (SELECT user_id AS doc_id, count(*) AS votes FROM events GROUP BY user_id)"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as store status: quality 1 is ok, 0 failed; toxic is tainted."""
    quality = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "failed")
    return load(spark, sf_dir, "labels").select("doc_id", quality.alias("status"), (F.col("toxic") == 1).alias("tainted"))


STATUSES_SQL = "statuses AS (SELECT doc_id, CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'failed' END AS status, toxic = 1 AS tainted FROM labels)"
