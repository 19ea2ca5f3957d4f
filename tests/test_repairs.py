import pytest

from papyrium.functions import repairs as R
from papyrium.functions.rewrites import lifted

DRAWN = "a\n\\matrix (m) [matrix of nodes] at (current bounding box.south) {\n\\node{x}; a\\\\b \\\\\n};\nz"


@pytest.mark.parametrize(
    ("repair", "text", "want"),
    [
        (R.space_layout_words, "\\parFrom (A) \\par中 \\parfrom", ("\\par From (A) \\par 中 \\parfrom", 2)),
        (R.space_layout_words, "\\def\\parFrom{x}\\parFrom a", ("\\def\\parFrom{x}\\parFrom a", 0)),
        (R.space_layout_words, "50\\% \\parIn a % \\parIn b\n\\begin{verbatim}\n\\parIn\n\\end{verbatim}\n\\parIn", ("50\\% \\par In a % \\parIn b\n\\begin{verbatim}\n\\parIn\n\\end{verbatim}\n\\par In", 2)),
        (R.space_layout_commands, "\\newpage中 \\newpages", ("\\newpage 中 \\newpages", 1)),
        (lambda c: R.drop_empty_groups(c, ("name", "nam")), "\\name{}中 \\nam{} 。 \\name{}a", ("\\name中 \\nam 。 \\name{}a", 2)),
        (lambda c: R.drop_empty_groups(c, ()), "\\name{}中", ("\\name{}中", 0)),
        (R.space_algorithm_commands, "  \\Comment中文 \n\\State中", ("  \\Comment{中文}\n\\State 中", 2)),
        (R.embolden_text_words, "\\textTest: \\textit{a} \\newcommand{\\textOwn}{b}\\textOwn .", ("\\textbf{Test}: \\textit{a} \\newcommand{\\textOwn}{b}\\textOwn .", 1)),
        (R.restore_math_alias, "\\newcommand{\\Imat}{I} \\I \\Id", ("\\newcommand{\\Imat}{I} \\Imat \\Id", 1)),
        (R.restore_math_alias, "\\def\\I{x}\\def\\Imat{I} \\I", ("\\def\\I{x}\\def\\Imat{I} \\I", 0)),
        (R.split_label_lists, "\\label{a}\\label{b} \\ref{a, b} \\ref{a,c} \\eqref{a,}", ("\\label{a}\\label{b} \\ref{a}, \\ref{b} \\ref{a,c} \\eqref{a,}", 1)),
        (R.matrix_breaks_as_spaces, DRAWN, (DRAWN.replace("a\\\\b", "a b"), 1)),
        (lambda c: R.omit_matrix_legends(c, "% gone"), DRAWN, ("a\n% gone\nz", 1)),
        (R.close_box_groups, "\\newtcolorbox{bx}{}\\begin{bx}\\begingroup a\\end{bx}\\begin{o}\\begingroup\\end{o}", ("\\newtcolorbox{bx}{}\\begin{bx}\\begingroup a\\endgroup\n\\end{bx}\\begin{o}\\begingroup\\end{o}", 1)),
        (R.close_box_groups, "\\begin{}\\begingroup\\end{}", ("\\begin{}\\begingroup\\end{}", 0)),
        (R.declare_keywords, "\\SetKwInOut{Input}{I}\n\\begin{algorithm}\\KwOut{x}\\Input{y}", ("\\SetKwInOut{Input}{I}\n\\SetKwInOut{KwOut}{Output}\n\\begin{algorithm}\\KwOut{x}\\Input{y}", 1)),
        (R.close_bold_heads, "\\textbf{结果。图~\\ref{a}", ("\\textbf{结果。}图~\\ref{a}", 1)),
        (R.close_inline_math, "$\\mathbf{x}\\) a\n\\(x\\) $\\pi\\)\nb\\)", ("$\\mathbf{x}$ a\n\\(x\\) $\\pi\\)\nb\\)", 1)),
        (R.compact_aux, "\\relax\n\\@writefile{toc}{x}\n\\newlabel{a}{{1}{2}{t}{s}{}}\n\\newlabel{b}{{1}{2}}\n\\newlabel{c}\n", ("\\relax\n\\newlabel{a}{{1}{2}}\n\\newlabel{b}{{1}{2}}\n", 3)),
    ],
)
def test_native(spark, repair, text, want):
    df = spark.createDataFrame([(text,), (None,), ("",), ("plain $1 text\\",)], "x string")
    rows = [tuple(r["y"]) for r in df.select(repair("x").alias("y")).collect()]
    assert rows == [want, ("", 0), ("", 0), ("plain $1 text\\", 0)]


def test_two_texts(spark):
    df = spark.createDataFrame([("\\href{http://a.b/c\nx \\href{q\n", "\\href{http://a.b/cd}{see}"), ("\\href{a\n", None)], "x string, s string")
    assert [tuple(r["y"]) for r in df.select(R.restore_links("x", "s").alias("y")).collect()] == [("\\href{http://a.b/cd}{see}\nx ", 2), ("", 1)]
    df = spark.createDataFrame([("\\citep[p.~1]{a, b}\\nocite{c,a}\\nocite{c}\\cite{a}\\cite{c}", "\\bibitem{a} \\bibitem[x]{d}"), ("\\cite{a}", "none")], "x string, s string")
    rows = [tuple(r["y"]) for r in df.select(R.mark_missing_citations("x", "s").alias("y")).collect()]
    mark = "\\textsuperscript{[" + R.NO_ENTRY + ":%s]}"
    assert rows == [("\\citep[p.~1]{a}" + mark % "b" + "\\nocite{a}\\cite{a}" + mark % "c", 2), ("\\cite{a}", 0)]


def test_lists(spark):
    df = spark.createDataFrame([("\\faGithub \\faIcon{x} \\faBook \\faGithub \\cite{b,a}\\citet{a, c}", "\\bibliography{refs}", " a.tex\n")], "x string, s string, t string")
    got = df.select(R.icon_commands("x"), R.cited_keys("x"), R.citation_aux("x", "s"), R.citation_aux("x"), R.citation_aux("s"), R.include_target("t")).first()
    aux = "\\relax\n\\citation{b}\n\\citation{a}\n\\citation{c}\n\\bibstyle{plainnat}\n\\bibdata{refs}\n"
    assert tuple(got) == (["faBook", "faGithub"], ["b", "a", "c"], aux, None, None, "a.tex")


def test_preamble():
    text = "% \\usefoo\n\\newcommand{\\x}{%\n  \\usefoo\n}\n\\begin{document}"
    assert R.find_token(text, "\\usefoo") == text.rindex("\\usefoo")
    assert R.find_token("50\\% \\a % \\b", "\\a") == 5 and R.find_token("% \\b", "\\b") == -1
    new, n = R.insert_in_preamble(text, "SNIP", ["usefoo"])
    assert n == 1 and new == text.replace("\\newcommand", "SNIP\n\\newcommand")
    assert R.insert_in_preamble(new, "SNIP", ["usefoo"]) == (new, 0)
    assert R.insert_in_preamble("a\n\\begin{document}\\usefoo", "S", ["\\usefoo"]) == ("a\nS\n\\begin{document}\\usefoo", 1)
    assert R.insert_in_preamble("a", "S") == ("a\nS\n", 1)


def test_balances():
    assert R.restore_options("\\begin{e}[中]x\\begin{e} [b]", "\\begin{e}[a=[1],\\]]\\begin{e}[b]", "e") == ("\\begin{e}[a=[1],\\]]x\\begin{e} [b]", 1)
    assert R.redelimit_verbs("\\verb|a|b\\?| and \\verb|x| \\verb|y|\n\\verb|(a|b)+| c") == ("\\verb|a|b\\?| and \\verb|x| \\verb|y|\n\\verb@(a|b)+@ c", 1)
    assert R.redelimit_verbs("\\verb|foo| bar \\verb") == ("\\verb|foo| bar \\verb", 0)
    assert R.drop_stray_braces("好。}图~\\ref{a}\n{好。}图1 \\{。}表中") == ("好。图~\\ref{a}\n{好。}图1 \\{。表中", 2)


def test_keys(spark):
    bib = "@a{x+y, t}@b{x_p, t}@c{xpy, t}@d{好#, t}"
    assert R.safe_key_names(bib) == {"x+y": "xpy_2", "好#": "好num"}
    assert R.safe_bibliography(bib) == ("@a{xpy_2, t}@b{x_p, t}@c{xpy, t}@d{好num, t}", 2)
    row = spark.createDataFrame([("\\cite[a]{x+y , x_p}", bib)], "x string, b string").select(lifted(R.safe_citations)("x", "b").alias("y")).first()["y"]
    assert tuple(row) == ("\\cite[a]{xpy_2,x_p}", 2)
