import random

from pyspark.sql import functions as F

from papyrium.functions import failures as X
from papyrium.operators.contained import _Passages, contained


def classified(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, phase string, log string, error string")
    return [r["x"] for r in df.select("i", X.classify("phase", "log", "error").alias("x")).orderBy("i").collect()]


def test_categories_and_what_to_do(spark):
    cases = {
        ("compile", "fatal: Image inclusion failed. Could not find file: assets/logo.png", None): "compile.asset_missing",
        ("compile", "! Undefined control sequence. l.42 \\method中文", None): "compile.undefined_command",
        ("compile", "Undefined control sequence. l.7 \\pdfinfoomitdate 1", None): "compile.pdftex_primitive",
        ("compile", "LaTeX Error: Environment CJK* undefined", None): "compile.legacy_cjk_environment",
        ("compile", 'Undefined control sequence. "translation": "\\\\section{a}"', None): "compile.model_response_leak",
        ("compile", 'fontspec Error: The font "SourceSans3-It" is lost', None): "compile.font_family_missing",
        ("compile", "Undefined control sequence. \\ifnum \\pdfshellescape >0", None): "compile.engine_driver_mismatch",
        ("compile", "Undefined control sequence. \\endtcolorbox ->x", None): "compile.unmatched_environment",
        ("compile", "Undefined control sequence. \\pgf@matrix@last@nextcell@options", None): "compile.tikz_matrix_legend",
        ("compile", "Undefined control sequence. l.72 \\nndiff{x}", None): "compile.duplicated_macro_initial",
        ("translate", None, "401 Unauthorized: invalid API key"): "translate.api_auth",
        ("translate", None, "Connection timed out"): "translate.network_timeout",
        ("translate", None, "insufficient_user_quota: balance $0.005 is insufficient"): "translate.api_quota",
        ("compile", "[x] timeout=600\n[x] 翻译覆盖率检查失败: cjk_pct=2.3%", None): "quality.untranslated_prose",
        ("compile", "fine", "process killed"): "compile.resource_exhaustion",
        ("compile", None, None): "compile.unknown",
        (None, None, None): "compile.unknown",
    }
    found = classified(spark, list(cases))
    assert [r["category"] for r in found] == list(cases.values())
    assert all(r["suggestion"] == X.SUGGESTIONS[r["category"]] and r["retryable"] == (r["retry_strategy"] != "manual_review") for r in found)
    every = {r[0] for r in (*X.TRANSLATE_LADDER, X.TRANSLATE_ELSE, *X.COMPILE_LADDER, X.COMPILE_ELSE, *X.QUALITY)}
    assert every == set(X.SUGGESTIONS)


def test_evidence(spark):
    far = "Undefined control sequence.\n" + "x" * 300 + "\\pdfoutput"
    shown = [r["evidence"] for r in classified(spark, [("compile", "a\n" + far, None), ("translate", None, "FileNotFoundError: it\nin the workfolder"), ("translate", None, "q" * 200 + " 429  now"), ("translate", None, "z" * 600)])]
    assert shown[0] == "a Undefined control sequence. " + "x" * 178
    assert shown[1] == ""  # found over two lines, which the evidence is not
    assert shown[2] == "q" * 99 + " 429 now" and shown[3] == "z" * 500


def test_quality_failures(spark):
    df = spark.createDataFrame([("quality.translation_refusal", "pages=[3]"), ("quality.untranslated_prose", None), ("other", "x")], "c string, e string")
    rows = [r["x"] for r in df.select(X.quality_failure("c", "e").alias("x")).collect()]
    assert rows[0]["repair_action"] == "retry_refused_translation" and rows[0]["evidence"] == "pages=[3]" and rows[0]["suggestion"] == X.SUGGESTIONS["quality.translation_refusal"]
    assert rows[1]["repair_action"] == "protect_examples_or_retranslate" and rows[1]["evidence"] == "" and rows[2] is None


def test_passages_by_brute_force():
    r = random.Random(3)
    for _ in range(150):
        letters = r.choice(["ab", "abcé日", "abcdefghij "])
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(120))) for _ in range(8)]
        passages = []
        for i in range(20):
            text = r.choice(texts)
            at = r.randrange(max(1, len(text)))
            passages.append((i, text[at : at + r.randrange(1, 60)] or "x"))
        passages += [(50 + i, "".join(r.choice(letters) for _ in range(r.randrange(1, 40)))) for i in range(10)] + [(99, passages[0][1])]
        want = sorted({(k, i) for k, t in enumerate(texts) for i, p in passages if p in t})
        assert sorted(_Passages(passages).within([t.encode() for t in texts])) == want


def test_passages_in_blocks(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "a 日本語 text " * 200_000), (5, "cat")], "doc_id int, text string")
    items = spark.createDataFrame([("a", "cat"), ("b", "the cat sat on the mat"), ("c", ""), ("d", None), ("e", "日本語 text a"), ("f", "dog"), ("g", "cat")], "item_id string, passage string")
    for size in (1_000_000, 5):
        found = contained(docs, items, "doc_id", "item_id", "text", "passage", block_chars=size).collect()
        assert sorted(map(tuple, found)) == [(1, "a"), (1, "b"), (1, "g"), (4, "e"), (5, "a"), (5, "g")]
    assert contained(docs, items.limit(0), "doc_id", "item_id", "text", "passage").count() == 0
