"""File sources: JSON indexes and stores, text backups, binaries and archives, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INDEX, PAPER


def _path_part(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def scan_indexes(spark: SparkSession, root: str, name: str = "index.json") -> DataFrame:
    """A row an index file below `root`: its fields, path, and _corrupt_record where it can't be read.

    A missing mode is taken from the first folder below the root, a missing key from the last.
    """
    schema = T.StructType([*INDEX.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    # A damaged record has no papers; naming both columns lets queries ask for the damage alone.
    rows = reader.json(root).withColumns({"path": F.col("_metadata.file_path"), "_corrupt_record": F.when(F.col("papers").isNull(), F.col("_corrupt_record"))})
    return rows.withColumns({"mode": F.coalesce("mode", F.nullif(_path_part(rf"/{base}/([^/]+)/"), F.lit(""))), "key": F.coalesce("key", F.nullif(_path_part(r"/([^/]+)/[^/]+$"), F.lit("")))}).orderBy("path")


def entries(indexes: DataFrame) -> DataFrame:
    """A row a paper of each index, with its place."""
    kept = indexes.select("mode", "key", "path", F.posexplode("papers").alias("pos", "paper"))
    return kept.select("mode", "key", "path", "pos", "paper.*")


def strict_indexes(spark: SparkSession, root: str, name: str = "index.json") -> DataFrame:
    """The indexes, if every file is an object whose papers are an array of objects with non-blank ids.

    The check runs before anything can be written; one violation fails the whole batch.
    """
    rows = scan_indexes(spark, root, name)
    bad = F.col("_corrupt_record").isNotNull() | F.col("papers").isNull() | F.exists("papers", lambda p: p.isNull() | (F.trim(F.coalesce(p["arxiv_id"], F.lit(""))) == ""))
    found = rows.filter(bad).select("path").limit(3).collect()
    if found:
        raise ValueError("indexes that can't be trusted: " + ", ".join(r["path"] for r in found))
    return rows


def index_has_papers(papers: str = "papers") -> Column:
    return F.coalesce((F.size(papers) > 0) & F.forall(papers, lambda p: F.trim(F.coalesce(p["arxiv_id"], F.lit(""))) != ""), F.lit(False))


def ordered_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes in scan order: daily, weekly, monthly, manual, then the rest; keys latest first."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ("daily", "weekly", "monthly", "manual"))), F.col("mode")), F.lit(0))
    return indexes.withColumn("_place", F.when(place > 0, place).otherwise(99)).orderBy("_place", "mode", F.desc("key")).drop("_place")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The paper store, one JSON a paper; damaged files come with _corrupt_record and the id of their name."""
    schema = T.StructType([*PAPER.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    return rows.withColumn("arxiv_id", F.coalesce("arxiv_id", _path_part(r"/([^/]+)\.json$")))


def read_json_or(spark: SparkSession, path: str, schema: T.StructType, default: dict) -> DataFrame:
    """JSON rows with `default` values where a file, a record or a field is missing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
        rows = rows.select("*")
        rows.schema  # the path is resolved here
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows.select(*(F.coalesce(F.col(f.name), F.lit(default.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields))


def tex_backups(spark: SparkSession, root: str, suffix: str = "_merge_translate_zh.tex") -> DataFrame:
    """id and text of each translated TeX backup."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    return rows.select(_path_part(rf"/([^/]+){suffix.replace('.', chr(92) + '.')}$").alias("arxiv_id"), F.col("value").alias("text"))


def pdf_files(spark: SparkSession, root: str, min_bytes: int = 10_240) -> DataFrame:
    """path, id, length, modification time and validity of each PDF: large enough, with header and trailer."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    head = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    tail = F.contains(F.expr("right(content, 4096)"), F.lit(b"%%EOF"))
    return rows.select("path", F.regexp_extract("path", r"/([^/]+)\.pdf$", 1).alias("arxiv_id"), "length", "modificationTime", ((F.col("length") > min_bytes) & head & tail).alias("valid"))


#: Where artifacts of each kind stand and how they are named.
ARTIFACT_PATHS = (
    ("pdf", r"/data/papers/(\d{4}\.\d{4,5})_zh\.pdf$"),
    ("sidecar", r"/logs/pdf_errors/(\d{4}\.\d{4,5})\.(?:json|log)$"),
    ("failed_tex", r"/data/tex_backup_failed/(\d{4}\.\d{4,5})_merge_translate_zh\.tex$"),
)


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, arxiv_id, length and modification time of the artifacts below `root`, from the files' metadata only:
    translated PDFs, failure sidecars with their logs, and TeX that failed. Other files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in ARTIFACT_PATHS:
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
        key = F.when(F.col("path").rlike(pattern), F.regexp_extract("path", pattern, 1)).otherwise(key)
    return rows.select("path", kind.alias("kind"), key.alias("arxiv_id"), "length", "modificationTime").filter("kind IS NOT NULL")


#: Categories that a log may make clearer, the signs of a failed coverage check, and those of a phase.
VAGUE = ("compile.unknown", "unknown.unstructured")
COVERAGE, COVERAGE_IN_ENGLISH = "翻译覆盖率检查失败", "translation coverage"
PHASE, TRANSLATING = r"【失败阶段】\s+(translate|compile)", "GPT 翻译阶段"
_RECORD = ("category", "family", "retry_strategy", "repair_action")


def _coverage_window(text: str, before: int, after: int) -> Column:
    """The surroundings of the failed coverage check, or the whole log without one."""
    at = F.instr(text, F.lit(COVERAGE))
    at = F.when(at > 0, at).otherwise(F.instr(F.lower(text), F.lit(COVERAGE_IN_ENGLISH)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + after - start)).otherwise(F.col(text))


def failure_records(sidecars: DataFrame, logs: DataFrame, before: int = 120, after: int = 360) -> DataFrame:
    """A row a failure by id: those of sidecars, and the classified logs of ids without one.

    A sidecar whose category says little is classified anew from its log, bounded where a coverage check failed; it
    stays as it is if the log says no more. sidecars: arxiv_id, phase and the fields of a record; logs: arxiv_id, text.
    """
    from ..functions.failures import classify

    nothing = F.lit("")
    both = sidecars.join(logs.select("arxiv_id", F.coalesce("text", nothing).alias("_text")), "arxiv_id", "left")
    again = F.when(F.col("category").isin(*VAGUE) & F.col("_text").isNotNull(), classify(F.lit("compile"), _coverage_window("_text", before, after), nothing))
    both = both.withColumn("_again", again)
    better = F.coalesce(F.col("_again.category") != "compile.unknown", F.lit(False))
    kept = both.select(
        "arxiv_id", "phase", *(F.when(better, F.col(f"_again.{c}")).otherwise(F.col(c)).alias(c) for c in _RECORD),
        F.when(better, F.col("category")).alias("reclassified_from"), F.lit(False).alias("legacy_log"),
    )
    alone = logs.join(sidecars.select("arxiv_id"), "arxiv_id", "left_anti").withColumn("text", F.coalesce("text", nothing))
    named = F.nullif(F.regexp_extract("text", PHASE, 1), nothing)
    alone = alone.withColumn("phase", F.coalesce(named, F.when(F.contains("text", F.lit(TRANSLATING)), "translate").otherwise("compile")))
    # The classifier reads a log or another text by the phase, here the same.
    alone = alone.withColumn("_x", classify("phase", F.when(F.col("phase") == "compile", F.col("text")).otherwise(nothing), F.when(F.col("phase") == "translate", F.col("text")).otherwise(nothing)))
    fresh = alone.select("arxiv_id", "phase", *(F.col(f"_x.{c}").alias(c) for c in _RECORD), F.lit(None).cast("string").alias("reclassified_from"), F.lit(True).alias("legacy_log"))
    return kept.unionByName(fresh).orderBy("arxiv_id")


def result_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, result (pdf, error or unknown), detail and diagnosis of each driver log: its first line with a result, and
    the JSON of its first diagnosis, null where that is damaged."""
    files = spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r\n?|\n").alias("lines"))
    first = lambda pattern: F.get(F.filter("lines", lambda x: x.rlike(pattern)), F.lit(0))
    rows = files.select("path", first("^RESULT:(SUCCESS|ERROR):").alias("said"), F.substring(first("^PDF_DIAGNOSIS:"), len("PDF_DIAGNOSIS:") + 1, 1 << 30).alias("found"))
    result = F.when(F.col("said").startswith("RESULT:SUCCESS:"), "pdf").when(F.col("said").isNotNull(), "error").otherwise("unknown")
    detail = F.coalesce(F.regexp_extract("said", "^RESULT:[A-Z]+:(.*)$", 1), F.lit(""))
    return rows.select("path", result.alias("result"), detail.alias("detail"), F.when(F.try_parse_json("found").isNotNull(), F.col("found")).alias("diagnosis"))


def archive_members(spark: SparkSession, root: str, max_members: int = 50_000, max_bytes: int = 2 << 30) -> DataFrame:
    """For each tar archive whether it is safe to unpack, and why not: too many or too large members,
    paths or links that leave the folder, devices."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("path").rlike(r"\.(tar|tar\.gz|tgz)$")).select("path", "content")

    def check(batches):
        import io
        import posixpath
        import tarfile

        import pandas as pd

        def inside(name: str) -> bool:
            path = posixpath.normpath(name)
            return not (path.startswith(("/", "..")) or "\\" in name)

        def reason(raw: bytes) -> str:
            members = size = 0
            try:
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        members, size = members + 1, size + m.size
                        if members > max_members:
                            return "too_many_members"
                        if size > max_bytes:
                            return "too_large"
                        if not inside(m.name):
                            return "path_escape"
                        if m.issym() and not inside(posixpath.join(posixpath.dirname(m.name), m.linkname)) or m.islnk() and not inside(m.linkname):
                            return "link_escape"
                        if not (m.isfile() or m.isdir() or m.issym() or m.islnk()):
                            return "special_file"
            except (tarfile.TarError, EOFError, OSError):
                return "unreadable"
            return ""

        for frame in batches:
            yield pd.DataFrame({"path": frame["path"], "reason": [reason(c) for c in frame["content"]]})

    return files.mapInPandas(check, "path string, reason string")


def listed_keys(entries_: DataFrame, pattern: str = ".*") -> DataFrame:
    return entries_.select("key").distinct().filter(F.col("key").rlike(pattern)).orderBy(F.desc("key"))
