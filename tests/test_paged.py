from papyrium.operators.paged import classify_pages, paged_report

ENGLISH = ("We show that the proposed planning method improves the results of every agent in the study. " * 12).strip()
CHINESE = "本文提出一种新的规划方法并在多个数据集上验证其有效性。" * 14


def report(spark, *pages):
    df = spark.createDataFrame([(1, "\f".join(pages))], "id int, text string")
    found = classify_pages(df, "id", "text")
    return [r["kind"] for r in found.orderBy("pos").collect()], paged_report(found, "id").first()


def test_run_of_english_pages(spark):
    refs = "References\n" + "[1] A. Author, some title, 2020.\n" * 30
    more = "[9] B. Author, other title, 2021.\n" * 30
    kinds, r = report(spark, CHINESE, CHINESE, *[ENGLISH] * 6, refs, more, more, more, "")
    assert kinds == ["analyzable"] * 8 + ["reference"] * 4
    assert (r["dominant_pages"], r["longest_run"], r["reference_pages"], r["untranslated"]) == (6, 6, 4, True)


def test_appendix_ends_references(spark):
    kinds, r = report(spark, CHINESE, "References\n[1] x\n", "more\nAppendix A\n" + CHINESE)
    assert kinds == ["analyzable", "reference", "analyzable"] and not r["untranslated"]


def test_kinds(spark):
    kinds, r = report(spark, "抱歉，我无法翻译该内容。", "Contents\n" + ENGLISH, "short", "user: a\nassistant: b\n" + ENGLISH, "Theorem 1\n" + ENGLISH)
    assert kinds == ["refusal", "structural", "short", "source", "analyzable"]
    assert r["refused"] and r["partial_pages"] == 1


def test_empty(spark):
    kinds, r = report(spark, "")
    assert kinds == ["short"] and not r["untranslated"]
