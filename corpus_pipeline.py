"""The corpus pipeline over `documents`: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again as the next stage's documents. All stages but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrium.llm import decontaminate, jaccard_join, language_id, line_dedup, source_mix
from papyrium.llm._session import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or beyond every language's calibrated cross-entropy.

    Null texts have no letter. Rows that repeat an id are judged each by itself; one with a null id counts as one of
    the training fold by the empty text. An empty table stays empty.
    """
    known = language_id.fit(docs.filter(language_id.fold("doc_id", 4) != language_id.HELD))
    return language_id.identify(docs, known).filter(~F.col("rejected")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document that holds them; texts and n_chars change.

    A document that loses every line stays with an empty text; the mix takes nothing of it. Null texts become
    empty. Rows that repeat an id are one document; rows with a null id keep their lines.
    """
    return _resized(line_dedup.dedup_lines(docs))


#: Words of a shingle and the similarity (num / den) from which documents are near copies.
SHINGLE, NUM, DEN = 5, 80, 100


def _node(doc_id: str, of: Column) -> Column:
    """Names a row by id and text, in the order of ids."""
    high = F.col(doc_id).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.col(doc_id).isNotNull(), F.concat(F.lpad(high.cast("string"), 20, "0"), F.lit(":"), F.hex(of)))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: the one with the smallest id.

    The input is what line dedup left, so copies whose lines went are no longer copies here: their texts are
    empty. Documents without words and rows with a null id link with nothing and stay. Where rows repeat an id, rows
    of equal id and text are one document (of them the smallest by lang, source, n_chars stays), and rows of
    equal id and different texts are different documents.
    """
    docs = docs.select(*COLUMNS)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if not repeated:
        return _first_of_groups(docs, "doc_id")
    rest = F.struct("lang", "source", "n_chars", "text")
    named = docs.filter("doc_id IS NOT NULL").withColumn("node", _node("doc_id", F.xxhash64("text")))
    one = named.groupBy("doc_id", "node").agg(F.min(rest).alias("rest")).select("doc_id", "rest.*", "node")
    return _first_of_groups(written(one), "node").unionByName(docs.filter("doc_id IS NULL"))


def _first_of_groups(docs: DataFrame, id_col: str) -> DataFrame:
    found = jaccard_join.join(docs, id_col=id_col, shingle=SHINGLE, num=NUM, den=DEN)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti").select(*COLUMNS)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts hold none. Rows are judged one by one."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), action="documents").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many copies of each, the words taken and the source's target.

    Rows are numbered and meet their copies by number, so that rows that repeat an id, or have none, get their own.
    """
    numbered = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    mixed = source_mix.mix(numbered, row_col="_row").filter("copies > 0").select("row", "copies", "taken", "target")
    return numbered.join(mixed, F.col("_row") == F.col("row")).select(*COLUMNS, "copies", "taken", "target")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("source_mix", mix_sources),
]

#: The stages' models and random rounding can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
