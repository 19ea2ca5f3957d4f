"""What queries hold and do at once stays within bounds as tables grow."""

from pyspark.sql import functions as F

from papyrium.batches import BATCH_BYTES
from papyrium.plans.common import load


def _long_texts(spark, folder, rows=60, size=500_000):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), size // 5).alias("text"))
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def _sizes(frames):
    import pandas as pd

    for f in frames:
        yield pd.DataFrame({"size": [int(f["text"].str.len().sum())]})


def test_python_gets_texts_in_bounded_bytes(spark, tmp_path):
    _long_texts(spark, tmp_path)
    sizes = [r["size"] for r in load(spark, str(tmp_path), "documents").select("text").mapInPandas(_sizes, "size long").collect()]
    assert sum(sizes) == 60 * 500_000 and max(sizes) <= BATCH_BYTES + 500_000


def test_boundaries_of_chunks():
    from papyrium.functions.chunks import _depths

    assert list(_depths(r"a{b$}c$d\{e$f}")) == [1, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 1]
    assert list(_depths("\\")) == [1, 0] and list(_depths("")) == [1] and list(_depths("}}{")) == [1, 1, 1, 1]


def test_missing_citations_of_a_long_text_are_looked_up(spark):
    """Keys times entries: a billion comparisons where each key walks the entries."""
    import time

    from papyrium.functions.repairs import NO_ENTRY, mark_missing_citations

    n = 50_000
    name = lambda x: F.concat(F.lit("key"), x.cast("string"))
    ids = F.sequence(F.lit(1), F.lit(n))
    tex = F.concat(F.lit("\\cite{"), F.array_join(F.transform(ids, name), ","), F.lit("}"))
    entries = F.array_join(F.transform(F.filter(ids, lambda x: x % 2 == 0), lambda x: F.concat(F.lit("\\bibitem{"), name(x), F.lit("}"))), "")
    row = spark.range(1).select(tex.alias("tex"), entries.alias("entries"))
    began = time.time()
    got = row.select(mark_missing_citations("tex", "entries").alias("r")).select("r.*").first()
    assert time.time() - began < 15
    has, lacks = (",".join(f"key{i}" for i in range(k, n + 1, 2)) for k in (2, 1))
    assert got["n"] == n // 2 and got["text"] == f"\\cite{{{has}}}\\textsuperscript{{[{NO_ENTRY}:{lacks}]}}"


def test_pages_are_read_once_and_in_bounded_bytes(spark, tmp_path):
    from papyrium.operators.paged import classify_pages, paged_report

    _long_texts(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    report = paged_report(classify_pages(docs, "doc_id", "text"), "doc_id")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    got = report.first()
    assert (got["pages"], got["dominant_pages"], got["longest_run"]) == (1, 1, 1)


def test_longest_run_of_pages(spark):
    from papyrium.operators.paged import paged_report

    rows = [(k, pos, "analyzable", 0, 0, 0, pos in own, False) for k, own in ((1, {1, 3, 4, 5, 7, 8}), (2, set()), (3, {9})) for pos in range(9, 0, -1)]
    pages = spark.createDataFrame(rows, "id int, pos int, kind string, script long, letters long, words long, dominant boolean, partial boolean")
    assert {r["id"]: r["longest_run"] for r in paged_report(pages, "id").collect()} == {1: 3, 2: 0, 3: 1}


def test_letters_of_other_case_still_name_a_section():
    from papyrium.operators.paged import SCRIPT, _Reader

    reader = _Reader(SCRIPT)
    assert [len(reader.matches("references", t, t.lower())) for t in ("REFERENCES", "Reﬀerences", "Referenceſ", "bıblıography", "none")] == [1, 0, 1, 1, 0]


def test_passages_are_found_in_bounded_bytes(spark):
    from papyrium.operators import contained as C

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [(i, "x" * (C.SLICE_BYTES // 3 + i) + ("a passage" if i % 2 else "") + "y") for i in range(9)]
    docs, items = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([("p", "a passage"), ("q", "passage not here")], "item_id string, text string")
    got = C.contained(docs, items, "doc_id", "item_id", "text").collect()
    assert sorted(tuple(r) for r in got) == [(i, "p") for i in (1, 3, 5, 7)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES


def test_plain_pieces_that_artifacts_need():
    from papyrium.functions.artifacts import ARTIFACTS
    from papyrium.functions.rewrites import _needed

    assert [_needed(p) for p in ("a|bc", "(?i)AB+cd[x]{2}eF", "x(?:abc|b)yz?", r"(?m)^[ \t]*\{q\s+rs", "[]a]b")] == ["", "cd", "x", "{q", "b"]
    assert all(_needed(p) for p in ARTIFACTS)
    assert _needed(ARTIFACTS[0]) == '"translation"' and _needed(r"(?i)Certainly!\s*(?=[一-鿿])") == "Certainly!"


def test_a_splitters_page_is_read_once(spark):
    from papyrium.functions.chunks import splitter_nodes

    page = 'x<p style="color:red;">#[1-2]a&lt;b#</p><p style="color:black;"></p><p style="color:blue;">no</p>\n<p style="color:black;">c<br/>d#</p>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "page string").select(splitter_nodes("page").alias("nodes"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [None if r["nodes"] is None else [tuple(n) for n in r["nodes"]] for r in df.collect()] == [[("a<b", True), ("", False), ("c\nd", False)], None, []]


def test_abstracts_by_their_marks(spark):
    from papyrium.functions.backfill import abstract_of

    b, e = "\\begin{abstract}", "\\end{abstract}"
    texts = [f"{e}x{b}one\ntwo{e}{b}three{e}", f"{b}{e}", f"{b}no end", f"no begin{e}", f"文{b}文字{b}a{e}", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tex string")
    assert [r["a"] for r in df.orderBy("i").select(abstract_of("tex").alias("a")).collect()] == ["one\ntwo", "", "", "", f"文字{b}a", ""]


def test_backfill_cuts_sentences_once(spark):
    from papyrium.functions.backfill import summary_of

    df = spark.createDataFrame([("一。 二！三",), ("none",)], "x string").select(summary_of("x", limit=3).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["s"] for r in df.collect()] == ["一。二！", "none"]
