import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyrium.llm import fill_middle

from .util import SCHEMA, corpus, frame

UNITS = {
    "words": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"),
    "lines": re.compile(r"[^\n]*\n|[^\n]+"),
    "sentences": re.compile(r"(?s).*?[.!?](?=[\x20\x09-\x0D])|.+"),
}


def brute(i, text, grammar="words", seed=42, percent=50, spm=80):
    text = text or ""
    pieces = UNITS[grammar].findall(text)
    assert "".join(pieces) == text
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    out = corpus(3)
    extra = ["  lead", "trail  ", " \t\n ", "a", "<P>", "x <S> y", "x <M", "P> <", "<", "a <P b <S c <M d", "𝒳 𝒴𝒵 \U0001f600 é", "a\x1cb\x85c d e", "one. Two! three? four.five", ". ! ?", "\n\n\n", "l1\nl2\r\nl3"]
    out += [(500 + k, t, "en", "s", 1) for k, t in enumerate(extra * 4)]
    return [*out, *out[:3], (None, "a null id has a text", "en", "s", 1), (-5, "a negative id too", "en", "s", 1)]


@pytest.mark.parametrize("grammar", sorted(UNITS))
def test_against_brute_force(spark, grammar):
    given = rows()
    docs = frame(spark, given).selectExpr("*", "'x' AS row", "'y' AS units", "3 AS `a.b`", "4 AS h", "9 AS OUTPUT", "'z' AS prefix")
    out = fill_middle.fill_middle(docs, grammar=grammar, percent=80, spm_percent=60)
    assert out.columns.count("output") == 1 and "OUTPUT" not in out.columns
    out = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    found = Counter()
    for r in out.collect():
        assert r["back"] == (r["text"] or "") and (r["row"], r["units"], r["a.b"], r["h"], r["prefix"]) == ("x", "y", 3, 4, "z")
        found[r["doc_id"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]] += 1
    assert found == Counter((i, *brute(i, t, grammar, percent=80, spm=60)) for i, t, *_ in given)


def test_forms_and_seeds(spark):
    docs = frame(spark, [(i, f"some words of text {i}", "en", "s", 1) for i in range(2000)])
    forms = {r["form"]: r["count"] for r in fill_middle.fill_middle(docs).groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 720 < forms["spm"] < 880 and 140 < forms["psm"] < 260
    one, two = ({r["doc_id"]: r["output"] for r in fill_middle.fill_middle(docs, seed=s).collect()} for s in (42, 43))
    assert one != two and one[7] == brute(7, "some words of text 7")[-1]
    assert {r["form"] for r in fill_middle.fill_middle(docs, percent=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_middle(docs, sentinels=("<P>", "<P<", "<M>"))
    marks = ("pre", "suf", "mid")
    own = fill_middle.fill_middle(docs, sentinels=marks, percent=100).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks))
    assert all(r["back"] == r["text"] and r["form"] != "plain" for r in own.collect())


def test_long_text_and_empty_table(spark):
    long = "word and word " * 400_000
    given = [(i, long, "en", "s", 1) for i in range(4)] + [(9, "x" * 5_000_000, "en", "s", 1)]
    out = fill_middle.fill_middle(frame(spark, given), percent=100).select("doc_id", "n_units", "form", F.md5("output").alias("d")).collect()
    want = {i: brute(i, t, percent=100) for i, t, *_ in given}
    assert {r[0]: (r[1], r[2], r[3]) for r in out} == {i: (w[0], w[1], hashlib.md5(w[4].encode()).hexdigest()) for i, w in want.items()}
    assert fill_middle.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    given = [r for r in {x[0]: x for x in rows()}.values()]
    frame(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    df = fill_middle.op12_fill_middle(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (*brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t, *_ in given}
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == want
