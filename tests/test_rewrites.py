import pytest
from pyspark.sql import functions as F

from papyrium.functions import rewrites as R
from papyrium.functions import text as T


@pytest.mark.parametrize(
    ("repair", "text", "want"),
    [
        (R.collapse_spaced_cjk, "中 文 ab 字", ("中文 ab 字", 1)),
        (R.drop_cjk_escapes, "\\中\\a", ("中\\a", 1)),
        (R.name_bare_citations, "如\\cite中 \\cite{a}", ("如文献中 \\cite{a}", 1)),
        (R.space_declarations, "\\bf中 \\bfx", ("\\bf 中 \\bfx", 1)),
        (R.plain_references, "\\cref{a} \\Cref[x]{b} \\ref{c}", ("\\ref{a} \\ref{b} \\ref{c}", 2)),
        (R.comment_endinput, "a\n \\endinput\nb", ("a\n % \\endinput\nb", 1)),
    ],
)
def test_native(spark, repair, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(repair("x").alias("y")).first()["y"]
    assert tuple(row) == want


@pytest.mark.parametrize(
    ("repair", "text", "want"),
    [
        (R.separate_macro_glue, "\\newcommand{\\name}{X}\\name中 \\name\\中", ("\\newcommand{\\name}{X}\\name{}中 \\name{}中", 2)),
        (R.undouble_macro_initials, "\\def\\name{X} \\nname and \\other", ("\\def\\name{X} \\name and \\other", 1)),
        (R.drop_unmatched_ends, "\\end{a}\\begin{a}\\end{a}\\end{a}", ("\\begin{a}\\end{a}", 2)),
        (R.plain_dashes_in_keys, "\\ref{a\u2013b} a\u2013b", ("\\ref{a-b} a\u2013b", 1)),
        (R.split_long_citations, "\\cite{a,b,c,d} \\cite{e}", ("\\cite{a,b,c}\\cite{d} \\cite{e}", 1)),
        (R.demote_caption_headings, "\\caption{a \\section{b}} \\section{c}", ("\\caption{a \\textbf{b}} \\section{c}", 1)),
        (R.resolve_labels, "\\label{fig:a_b}\\ref{fig:a} \\ref{fig/a_b} \\ref{x}", ("\\label{fig:a_b}\\ref{fig:a_b} \\ref{fig:a_b} \\ref{x}", 2)),
        (R.separate_macro_glue, "", ("", 0)),
    ],
)
def test_plain(repair, text, want):
    assert repair(text) == want


def test_lifted_and_chained(spark):
    df = spark.createDataFrame([("\\cite{a,b,c,d}",), (None,)], "x string")
    rows = df.select(R.lifted(R.split_long_citations)("x").alias("y")).collect()
    assert [tuple(r["y"]) for r in rows] == [("\\cite{a,b,c}\\cite{d}", 1), ("", 0)]
    assert tuple(df.select(R.strip_artifacts("x", ("a,", "[bc],")).alias("y")).first()["y"]) == ("\\cite{d}", 3)
    assert R.restore_blocks("\\begin{v}x\\end{v}\\begin{v}y\\end{v}", "\\begin{v}x\\end{v}\\begin{v}z\\end{v}", "v") == ("\\begin{v}x\\end{v}\\begin{v}z\\end{v}", 1)
    score = T.main_document_score(F.lit("a/Main.tex"), F.lit("\\input{sec/intro.tex}"), F.array(F.lit("intro")))
    assert spark.range(1).select(score.alias("s")).first()["s"] == 120
