"""Records read from and written to files: stores, logs, artifacts, completions, pages and what becomes of them."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrium.functions import gate as G
from papyrium.functions.text import metadata_complete, translation_complete
from papyrium.operators import markup as M
from papyrium.operators import reconcile as R
from papyrium.sources import files as S
from papyrium.sources import sinks as K


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"choices": [{"message": {"content": "plain"}}]}, "plain"),
        ({"choices": [{"message": {"content": "[1] cited"}}]}, "[1] cited"),
        ({"choices": [{"message": {"content": ["a", {"text": "b"}, {"text": {"value": "c"}}, {"text": " "}, {"type": "image"}, 7]}}]}, "a\nb\nc"),
        ({"choices": [{"message": {"content": " \n", "reasoning_content": "thought"}}]}, "thought"),
        ({"choices": [{"message": {"content": [{"text": ""}]}, "text": "old form"}]}, "old form"),
        ({"choices": [{"message": None, "text": "old form"}]}, "old form"),
        ({"choices": [{"message": {"content": 5}}]}, None),
        ({"choices": []}, None),
        ({"error": "x"}, None),
        ([1], None),
    ],
)
def test_completions(spark, payload, want):
    assert one(spark, json.dumps(payload), G.normal_completion) == want


def test_damaged_completions(spark):
    assert one(spark, '{"choices": [', G.normal_completion) is None and one(spark, None, G.normal_completion) is None


def test_retry_prompt(spark):
    structural = lambda x: G.retry_prompt(x, F.lit("citation_structure_mismatch"))
    once = one(spark, "Translate.", structural)
    assert once == "Translate." + G.RETRY_REMINDER and one(spark, once, structural) == once
    assert one(spark, "Translate.", lambda x: G.retry_prompt(x, F.lit("quota"))) == "Translate."
    assert one(spark, None, lambda x: G.retry_prompt(x, F.lit(None).cast("string"))) == ""


def test_abstract_page(spark):
    page = """<h1 class="title mathjax" id="t"><span class="descriptor">Title:</span>
    A &amp; <i>B</i> </h1><div class="authors"><span class="descriptor"></span><a href="/a">Ann A</a>, <a>Bo
    B</a>, </div> [Submitted on 3 Mar 2024 (<a>v1</a>), last revised]
    <blockquote class="abstract mathjax">\n<span class="descriptor">Abstract:</span>Two\n  lines. </blockquote>"""
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    assert rows(M.abstract_page(df, "id", "html"), "*") == [
        # The label goes only where it stands at the head of the block.
        (1, "A &amp; B", "Abstract:Two lines.", "Ann A, Bo B", "3 Mar 2024"),
        (2, "", "", "", ""),
        (3, "", "", "", ""),
    ]


def test_artifacts_and_their_end(spark, tmp_path):
    now = time.time()
    old, names = now - 10 * 86400, ["data/papers/2401.00001_zh.pdf", "data/papers/2401.00002_zh.pdf", "data/papers/2401.00001.pdf", "logs/pdf_errors/2401.00003.json", "logs/pdf_errors/2401.00003.log"]
    for n in [*names, "data/tex_backup_failed/2401.00004_merge_translate_zh.tex", "data/papers/2401.00004_merge_translate_zh.tex", "logs/pdf_errors/summary.json"]:
        os.utime(put(tmp_path, n, "12345"), (old, old))
    put(tmp_path, "data/papers/2401.00005_zh.pdf", "young")
    found = S.artifacts(spark, str(tmp_path))
    assert rows(found, "kind", "arxiv_id") == [
        ("failed_tex", "2401.00004"), ("pdf", "2401.00001"), ("pdf", "2401.00002"), ("pdf", "2401.00005"), ("sidecar", "2401.00003"), ("sidecar", "2401.00003"),
    ]
    references = spark.createDataFrame([("2401.00002",), ("2401.00005",), ("2401.00005",)], "arxiv_id string")
    plan = R.reclaimable(found, references, "arxiv_id", "modificationTime", F.lit(now).cast("timestamp"))
    assert rows(R.reclaim_counts(plan), "*") == [("failed_tex", 0, 0, 1, 5), ("pdf", 1, 1, 1, 5), ("sidecar", 0, 0, 2, 10)]


def test_failure_records(spark):
    fields = "arxiv_id string, phase string, category string, family string, retry_strategy string, repair_action string"
    vague = ("compile", "compile.unknown", "compile", "manual_review", "inspect_compile_log")
    sidecars = spark.createDataFrame([("a", *vague), ("b", *vague), ("c", *vague), ("d", "compile", "compile.asset_missing", "asset", "x", "y")], fields)
    far = "TeX capacity exceeded\n" + "." * 400
    logs = [("a", far + "Translation coverage check failed: 翻译覆盖率检查失败" + "." * 400), ("b", "nothing known"), ("d", "TeX capacity exceeded"), ("e", "【失败阶段】 translate\n余额不足"), ("f", "GPT 翻译阶段 401"), ("g", "TeX capacity exceeded"), ("h", None)]
    got = {r["arxiv_id"]: r for r in S.failure_records(sidecars, spark.createDataFrame(logs, "arxiv_id string, text string")).collect()}
    assert sorted(got) == list("abcdefgh")
    # The sign of another failure far from the check doesn't count.
    assert got["a"]["category"] != "compile.macro_recursion" and got["a"]["reclassified_from"] == "compile.unknown"
    assert [(got[k]["category"], got[k]["reclassified_from"]) for k in "bcd"] == [("compile.unknown", None), ("compile.unknown", None), ("compile.asset_missing", None)]
    assert [(got[k]["phase"], got[k]["category"], got[k]["legacy_log"]) for k in "efgh"] == [
        ("translate", "translate.api_quota", True), ("translate", "translate.api_auth", True), ("compile", "compile.macro_recursion", True), ("compile", "compile.unknown", True),
    ]


def test_result_lines(spark, tmp_path):
    put(tmp_path, "1.log", 'x RESULT:ERROR:no\nRESULT:SUCCESS:/a:b.pdf\nRESULT:ERROR:late\nPDF_DIAGNOSIS:{"a": 1}\nPDF_DIAGNOSIS:{}')
    put(tmp_path, "2.log", "one\r\nRESULT:ERROR:\r\nPDF_DIAGNOSIS:{bad\nPDF_DIAGNOSIS:{}")
    put(tmp_path, "3.log", "nothing")
    got = S.result_lines(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    assert rows(got, "*") == [("1.log", "pdf", "/a:b.pdf", '{"a": 1}'), ("2.log", "error", "", None), ("3.log", "unknown", "", None)]


def test_stores_and_json(spark, tmp_path):
    put(tmp_path, "papers/1.json", '{"arxiv_id": "1", "title": "t"}')
    put(tmp_path, "papers/2.json", '{"title": "no id"}')
    put(tmp_path, "papers/3.json", '{"title": ')
    assert rows(S.read_store(spark, f"{tmp_path}/papers"), "arxiv_id", "title") == [("1", "t"), ("2", "no id"), ("3", None)]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    put(tmp_path, "x.json", '{"a": 3}')
    assert rows(S.read_json_or(spark, f"{tmp_path}/x.json", schema, {"b": "none"}), "*") == [(3, "none")]
    assert S.read_json_or(spark, f"{tmp_path}/missing.json", schema, {"b": "none"}).count() == 0


def test_backups(spark, tmp_path):
    put(tmp_path, "a/2401.00001_merge_translate_zh.tex", b"one\ntwo \xff")
    put(tmp_path, "a/other.tex", "no")
    put(tmp_path, "a/2401.00002_merge_translate_zh.tex", "")
    got = dict(rows(S.tex_backups(spark, str(tmp_path)), "arxiv_id", "text"))
    assert got["2401.00001"].startswith("one\ntwo ") and set(got) <= {"2401.00001", "2401.00002"}


def test_keys_and_papers(spark):
    keys = spark.createDataFrame([("2024-01-02",), ("2024-01-10",), ("notes",), ("2024-01-02",)], "key string")
    assert [r["key"] for r in S.listed_keys(keys, r"^\d{4}-\d{2}-\d{2}$").collect()] == ["2024-01-10", "2024-01-02"]
    papers = [([("a",)], True), ([("a",), (" ",)], False), ([("a",), (None,)], False), ([], False), (None, False)]
    df = spark.createDataFrame(papers, "papers array<struct<arxiv_id string>>, want boolean")
    assert df.filter(S.index_has_papers() != F.col("want")).count() == 0


def test_completeness(spark):
    df = spark.createDataFrame([("标题", "摘要", True), ("标题", "english", False), (None, "摘要", False), ("", "", False)], "t string, s string, want boolean")
    assert df.filter(translation_complete("t", "s") != F.col("want")).count() == 0
    df = spark.createDataFrame([("t", "a", None, True), ("t", "", "s", True), ("t", None, " ", False), (" ", "a", "s", False), (None, "a", "s", False)], "t string, a string, s string, want boolean")
    assert df.filter(metadata_complete("t", "a", "s") != F.col("want")).count() == 0


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([("1", 0), ("2", 1)], "arxiv_id string, pos int")
    others = spark.createDataFrame([("2",)], "arxiv_id string")
    files = spark.createDataFrame([("1", "a.pdf"), ("2", "b.pdf")], "arxiv_id string, path string")
    gone = lambda key, errors: tuple(x.count() for x in K.delete_paper(index, others, files, key, errors))
    assert (gone("1", 0), gone("1", 1), gone("2", 0), gone("9", 0)) == ((1, 1), (1, 0), (1, 0), (2, 0))
    first = spark.createDataFrame([("w1", "2024-01-01", "a")], "key string, updated_at string, status string")
    every, latest = K.append_history(None, first)
    every, latest = K.append_history(every, spark.createDataFrame([("w1", "2024-01-02", "b"), ("w2", "2024-01-01", "c")], first.schema))
    assert every.count() == 3 and rows(latest, "key", "status") == [("w1", "b"), ("w2", "c")]
    v1 = K.replace_table(first, f"{tmp_path}/t")
    v2 = K.replace_table(v1.withColumn("status", F.lit("z")), f"{tmp_path}/t")
    assert (v1.first()["status"], v2.first()["status"]) == ("a", "z")
    marks = spark.createDataFrame([("l", "1"), ("l", "9"), ("m", "1")], "list_id string, arxiv_id string")
    papers = spark.createDataFrame([("1", "title")], "arxiv_id string, title string")
    assert rows(K.bookmark_lists(marks, papers), "list_id", "arxiv_id", "title", "list_size") == [("l", "1", "title", 2), ("l", "9", None, 2), ("m", "1", "title", 1)]
    assert rows(K.toggle_bookmark(marks, marks.limit(0)), "*") == rows(marks, "*")
    assert K.toggle_bookmark(marks, spark.createDataFrame([("l", "9")], marks.schema)).count() == 2
