"""Small fixed cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papyrium.functions import calendar as C
from papyrium.functions import chunks as K
from papyrium.functions import failures as X
from papyrium.functions import gate as G
from papyrium.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_week_keys(spark):
    assert one(spark, C.calendar_key(F.lit("2026-07-20").cast("date"), "weekly")) == "2026-W30"
    assert one(spark, C.calendar_key(F.lit("2024-12-30").cast("date"), "weekly")) == "2025-W01"
    assert [r["key"] for r in C.recent_keys(spark, "weekly", 3, "2026-06-28").collect()] == ["2026-W26"]
    assert C.recent_keys(spark, "daily", 0, "2026-06-28").count() == 0
    assert one(spark, C.monday_of(F.lit("2026-W30"))) == dt.date(2026, 7, 20)
    assert one(spark, C.week_dates(F.lit("2026-W30")))[-1] == dt.date(2026, 7, 26)
    assert one(spark, C.monday_of(F.lit("2026-W54"))) is None
    assert one(spark, C.last_full_week(F.lit("2026-07-20").cast("date"))) == "2026-W29"


@pytest.mark.parametrize(("mode", "key", "ok"), [("daily", "2024-02-30", False), ("daily", "2024-02-29", True), ("weekly", "2020-W53", True), ("weekly", "2021-W53", False), ("monthly", "2024-13", False), ("monthly", "2024-01", True)])
def test_key_validity(spark, mode, key, ok):
    assert one(spark, C.is_valid_key(F.lit(key), mode)) is ok


def test_pending_key(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, C.pending_key(at("2026-07-20 10:00:00"), "daily")) == "2026-07-20"
    assert one(spark, C.pending_key(at("2026-07-20 23:30:00"), "daily")) is None
    assert one(spark, C.pending_key(at("2026-07-25 10:00:00"), "weekly")) == "2026-W30"


def test_freshness(spark):
    day = F.lit("2024-01-31").cast("date")
    assert one(spark, C.freshness("d", day), d="2024-01-16") == 0.5
    assert one(spark, C.freshness("d", day), d="soon") == 0.2
    assert one(spark, C.freshness("d", day), d=None) == 0.2
    assert one(spark, C.freshness("d", day), d="2024-03-01") == 1.0
    assert one(spark, C.freshness("d", day), d="2020-03-01") == 0.0


def test_text(spark):
    assert one(spark, T.slug("x"), x="On Policy Distillation!") == "on-policy-distillation"
    assert one(spark, T.slug("x"), x="???") == "topic"
    assert one(spark, T.strip_comment("x"), x=r"a 5\% b % gone") == r"a 5\% b "
    assert one(spark, T.brace_balance("x"), x=r"{a \{ {b} % }") == 1
    assert one(spark, T.unescape_entities("x"), x="&lt;a&gt; &amp;lt;") == "<a> &lt;"
    assert one(spark, T.term_hit(F.col("x"), F.lit("Policy Gradient")), x="a policy of mine") == 0.5
    assert one(spark, T.term_hit(F.col("x"), F.lit("")), x="a") == 0.0
    assert one(spark, T.overlay("x", F.lit("old")), x="") == "old"
    assert one(spark, T.response_failed("x"), x="  ") is True
    assert one(spark, T.response_failed("x"), x="Error code: 429 - wait") is True
    assert one(spark, T.response_failed("x"), x=None) is True
    assert one(spark, T.quota_failed("x"), x="Balance is INSUFFICIENT") is True
    assert one(spark, T.rechunk(F.split("x", ","), 3), x="a,b,c,d") == [["a", "b", "c"], ["d"]]
    assert one(spark, T.script_share("x"), x="中文ab") == 50.0
    assert one(spark, T.words_bounded("x"), x="élan vital was") == 2


@pytest.mark.parametrize(
    ("phase", "log", "error", "category"),
    [
        ("translate", "", "HTTP 429 Too Many Requests", "translate.api_rate_limit"),
        ("translate", "", "your balance of 3 is insufficient", "translate.api_quota"),
        ("translate", "", "runtimeerror", "translate.unknown"),
        ("translate", "", "RuntimeError: x", "translate.plugin_runtime"),
        ("compile", "! Undefined control sequence.\n\\ffoo", "", "compile.duplicated_macro_initial"),
        ("compile", "! Undefined control sequence.\n\\pdfshellescape", "", "compile.engine_driver_mismatch"),
        ("compile", "", "Out of memory", "compile.resource_exhaustion"),
        ("compile", "verbatim ... LaTeX Error", "", "compile.verbatim_corruption"),
        ("compile", None, None, "compile.unknown"),
    ],
)
def test_failures(spark, phase, log, error, category):
    got = one(spark, X.classify("phase", "log", "error"), phase=phase, log=log, error=error)
    assert got["category"] == category
    assert got["retryable"] == (got["retry_strategy"] != "manual_review")


def test_evidence_is_bounded(spark):
    text = "a" * 300 + " RuntimeError here " + "b" * 400
    got = one(spark, X.classify("phase", "log", "error"), phase="translate", log="", error=text)["evidence"]
    assert "RuntimeError" in got and len(got) <= 100 + 12 + 180


def test_chunks():
    text = "One sentence here. " * 40 + r"\section{Next} {" + "word " * 60 + "}"
    parts = K.split_bounded(text, 200, 50)
    assert "".join(parts) == text
    assert max(map(len, parts[:-2])) <= 200
    assert any(p.startswith(r"\section") for p in parts)
    assert K.split_bounded("", 10) == [] and K.split_bounded(None, 10) == []
    assert K.split_bounded("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_coalesce():
    got = K.coalesce_fragments([("a ", False), ("b ", False), (" ", True), ("$x$", True), ("c", False), (r"\section{T}", False)], 10)
    assert "".join(t for t, _ in got) == r"a b  $x$c\section{T}"
    assert got[-1] == (r"\section{T}", False)


def test_chunk_cap(spark):
    assert one(spark, K.chunk_cap("x"), x=r"see \ref{a}") == 350
    assert one(spark, K.chunk_cap("x"), x=r"\cite{a} and \citep{b}") == 120
    assert one(spark, K.chunk_cap("x"), x=r"\cite{a}") == 1200


def test_gate(spark):
    reason = lambda s, r: one(spark, G.invalid_reason("s", "r"), s=s, r=r)
    assert reason("a {b}", "x {y}") == ""
    assert reason("a {b}", "x {y") == "latex_brace_balance_mismatch"
    assert reason(r"\section{a}", "{x}") == "critical_latex_structure_mismatch"
    assert reason(r"\cite{a, b} \cite{c}", r"\cite{c} \cite{a,b}") == ""
    assert reason(r"\cite{a}", r"\cite{b}") == "citation_structure_mismatch"
    words = F.transform(G.english_clauses("s"), lambda c: c["words"])
    assert one(spark, words, s="中文中文中文 we show that the model works 。") == [6]
    assert one(spark, words, s="we show that the model works") == []


def test_salvage(spark):
    got = one(spark, G.salvaged_json("x", ["a", "b"]), x='noise {"a": "one \\alpha", "b": "tw')
    assert got["a"] == "one \\alpha" or got["a"].startswith("one")
    assert got["b"] is None
