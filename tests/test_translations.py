"""Leftovers of a translation model, fields filled from TeX, splitter pages and reports on chunks."""

import pytest
from pyspark.sql import functions as F

from papyrium.functions.artifacts import ARTIFACTS
from papyrium.functions.backfill import backfilled, keywords_of, readable, summary_of
from papyrium.functions.chunks import splitter_nodes
from papyrium.functions.rewrites import strip_artifacts
from papyrium.operators import chunk_reports as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want, n",
    [
        (None, "", 0),
        ("", "", 0),
        ("plain words stay", "plain words stay", 0),
        ('a\n  "translation": "x \\" y\\n",  \nb', "a\n\nb", 1),
        ('["a", "b"]', "", 1),
        ('["a", "b"] tail', '["a", "b"] tail', 0),
        ("Certainly! 正文", "正文", 1),
        ("Certainly! text", "Certainly! text", 0),
        ("certainly!   below is the translated text:正文", "certainly!   正文", 1),
        # The sentence for input goes first, so what is before it stays unless it ends the text.
        ("前 as per your instructions.  Please provide the text you want me to translate. 后", "前 as per your instructions.   后", 1),
        ("前 as per your instructions.  Please provide the text you want me to translate.", "前 ", 2),
        ("as per your instructions. more", "as per your instructions. more", 0),
        ("请提供您希望我翻译的英文段落。正文", "正文", 1),
        ("近年来，迁移学习作为一种有效的方法被提出\n一\n二\\cite{mnih2015human}。三", "三", 1),
        ("please provide it\nin Chinese", "please provide it\nin Chinese", 0),
        ("Please provide it in Chinese now. Then", "", 1),
    ],
)
def test_artifacts(spark, text, want, n):
    assert tuple(one(spark, text, strip_artifacts)) == (want, n)


def test_artifacts_of_long_texts(spark):
    long = '"translation": "' + "x\\n" * 300_000 + '"'
    assert tuple(one(spark, f"a\n{long}\nb", strip_artifacts)) == ("a\n\nb", 1)
    assert one(spark, '"translation": "' + "x" * 500_000, strip_artifacts)["n"] == 0
    assert tuple(one(spark, "ab", lambda c: strip_artifacts(c, ()))) == ("ab", 0)
    assert len(ARTIFACTS) == len(set(ARTIFACTS)) == 58


def test_readable(spark):
    assert one(spark, r"\href{http://x}{\emph{链}接} \href{u}{t} \url{w} \cite{a}z \small[1] {b}", readable) == "http://x链接 t w z b"
    assert one(spark, r"*{\scriptsize\textbf{警告：甲 禁止移除或修改此警告。}} \\ 乙", readable) == "乙"
    assert one(spark, None, readable) == ""


def test_summaries_and_keywords(spark):
    assert one(spark, "一。 二！三？", summary_of) == "一。二！"
    assert one(spark, "没有句号" * 100, summary_of) == "没有句号" * 100
    assert one(spark, r"\keywords{a,b，c;d；e\and \it f,g,,h,i}", keywords_of) == list("abcdefgh")
    assert one(spark, r"\keywords{a,{b}}", keywords_of) == []
    assert one(spark, "none", keywords_of) == []


def test_backfill(spark):
    tex = r"\begin{abstract}甲。乙。丙。\end{abstract}\keywords{k}"
    rows = [(1, tex, None, None, None, "x"), (2, tex, "已有", "english", ["old"], "x"), (3, None, None, None, None, "x"), (4, r"\begin{abstract}no\end{abstract}", "e", None, [], "x"), (5, "", None, "", None, None)]
    df = spark.createDataFrame(rows, "id int, tex string, abstract_zh string, summary_zh string, keywords_zh array<string>, _kept string")
    got = {r["id"]: tuple(r[2:5]) for r in backfilled(df).collect()}
    assert got == {1: ("甲。乙。丙。", "甲。乙。", ["k"]), 2: ("已有", "甲。乙。", ["old"]), 3: (None, None, None), 4: ("e", None, []), 5: (None, "", None)}
    assert backfilled(df).columns == df.columns
    assert backfilled(df.limit(0)).count() == 0


def test_splitter_page(spark):
    page = '<p style="color:black;">#[1-2]a &lt;b&gt;<br/>c##</p>\n<p style="color:red;">\\begin{x}\n#</p><p style="color:blue;">no</p>'
    assert [tuple(x) for x in one(spark, page, splitter_nodes)] == [("a <b>\nc#", False), ("\\begin{x}\n", True)]
    assert one(spark, "", splitter_nodes) == []


def test_reports(spark):
    same = "This whole sentence was left as it is."
    rows = [
        (1, [(same, False), (f"  {same}\n", False), ("short", False), ("\\cite{aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa}", False), (same, True)], f"{same} \\cite{{aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa}}"),
        (2, [("译文 in part: " + same, False)], "译文"),
        (3, [], None),
        (4, None, "one two"),
        (5, [(f"四个汉字 {same}", False)], f"四个汉字 {same}"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, nodes array<struct<text string, preserve boolean>>, translated string")
    got = {r["doc_id"]: r for r in C.chunk_reports(df).collect()}
    assert (got[1]["total"], got[1]["transform"], got[1]["preserve"], got[1]["unchanged"]) == (5, 4, 1, 2)
    assert (got[1]["min_len"], got[1]["median_len"], got[1]["max_len"]) == (5, 39.0, 41) and got[1]["long_english_lines"] == 0
    assert [got[i]["unchanged"] for i in (2, 3, 4, 5)] == [0, 0, 0, 0]
    assert (got[3]["total"], got[4]["total"], got[3]["median_len"], got[4]["p90_len"]) == (0, 0, 0.0, 0)
    assert [r["doc_id"] for r in C.most_unchanged(C.chunk_reports(df)).collect()] == [1, 2, 3, 4, 5]
    total = C.overall(C.chunk_reports(df)).first()
    assert (total["papers"], total["transform"], total["unchanged"], total["unchanged_pct"]) == (5, 6, 2, 33.3)
    assert tuple(C.overall(C.chunk_reports(df.limit(0))).first()) == (0, 0, 0, 0, 0, 0.0)
    assert [tuple(r) for r in C.head_commands(df).collect()] == [("cite", 1)]


def test_long_english(spark):
    df = spark.createDataFrame([("one two three " * 3,), ("one \\cmd{two three four five} six seven eight nine ten " * 1,), ("a1 " * 30,), ("words, " * 8,)], "t string")
    papers = df.select(F.monotonically_increasing_id().alias("doc_id"), F.array().cast("array<struct<text:string,preserve:boolean>>").alias("nodes"), F.col("t").alias("translated"))
    assert [r["long_english_lines"] for r in C.chunk_reports(papers).orderBy("doc_id").collect()] == [1, 0, 0, 1]
