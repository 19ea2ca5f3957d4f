import random

import pytest
from pyspark.sql import functions as F

from papyrium.functions import gate as G
from papyrium.functions import prose as P
from papyrium.functions import source_data as S
from papyrium.operators import compile_logs as L
from papyrium.operators import source_sections as A
from papyrium.operators.source_blocks import line_modes


def values(spark, cases, column):
    """What a column of `x` (and `y`) gives for each case, in order."""
    rows = [(i, *(c if isinstance(c, tuple) else (c, None))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, x string, y string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


ORDERS = [
    r"Return only the corrected Python code inside one \promptfence{python} code block.",
    "Then provide your assessment in exactly three lines:",
    r"\item Do not output any further text outside the \texttt{<Analysis>} block",
    "You MUST output in this exact format, nothing outside the tags:",
    r"Please reason step by step, and put your final answer within \texttt{\textbackslash boxed\{\}}.",
]
BLOCK = "Write one <final_prompt> from the JSON template.\n<scene>{scene}</scene>\n<style>{style}</style>\nUse the exact template."


def test_orders_and_blocks(spark):
    prose = ["We return only the best code of each run.", "The prompt engineer wrote a method.", "A <method>x</method> in a sentence.", '{"a": 1, "b": 2, "c": 3, "d": 4}', "", None]
    assert values(spark, ORDERS + prose, S.is_order(F.col("x"))) == [True] * 5 + [False] * 6
    asked = "Answer me only with the translated text:\n\n" + BLOCK
    assert values(spark, [BLOCK, asked, "Return the template as <final_prompt>."] + prose, S.is_source_block(F.col("x"))) == [True, True, False] + [False] * 6
    assert values(spark, ["Answer me only with the translated text:\n\nx", "x", None], S.fragment(F.col("x"))) == ["x", "x", ""]


def test_boxes(spark):
    boxes = [
        ("tcolorbox", r"\begin{tcolorbox}[casebox=yellow!5, title=1. A Query]", True), ("tcolorbox", r"\begin{tcolorbox}[promptbox,title={Coarse Template}]", True),
        ("custombox", r"\begin{custombox}[title=Judge Prompt]", True), ("examplebox", r"\begin{examplebox}[title={One}]", True), ("examplebox", r"\begin{examplebox}", False),
        ("casebox", r"\begin{casebox}{successbg}{successframe}{x}", True), ("mdframed", r"\begin{mdframed}[frametitle={A Solving Prompt}]", True), ("tcolorbox", r"\begin{tcolorbox}[title=Key Insight]", False),
        ("custombox", r"\begin{custombox}[title=Main Theorem]", False), ("mdframed", r"\begin{mdframed}[frametitle={Details}]", False), ("tcolorbox", r"\begin{custombox}[title=Judge Prompt]", False),
    ]
    assert values(spark, [(line, env) for env, line, _ in boxes], S.marks_box("y", "x")) == [want for *_, want in boxes]
    fields = [(r"\textbf{Question:} what", True), (r"  \emph{Correct answer}: it", True), (r"\textbf{Theorem:} it", False), ("Question: what", False), (None, False)]
    assert values(spark, [x for x, _ in fields], S.names_field("x")) == [w for _, w in fields]


def modes(spark, lines, **kw):
    df = spark.createDataFrame([(1, "\n".join(lines))], "id int, text string")
    return [(r["mode"], r["block"]) for r in line_modes(df, "id", "text", **kw).orderBy("pos").collect()]


def test_order_stands_alone(spark):
    for order in ORDERS:
        assert modes(spark, [order, "This explanation has to be translated."]) == [("prompt", 1), ("body", None)]


@pytest.mark.parametrize("lines", [1199, 1200, 1201])
def test_prompt_ends_after_its_limit(spark, lines):
    found = modes(spark, ["Write the JSON template with <final_prompt>"] + ["text"] * (lines - 1))
    assert found[: min(lines, 1200)] == [("prompt", 1)] * min(lines, 1200) and found[1200:] == [("body", None)] * max(0, lines - 1200)


def test_prompt_begins_again(spark):
    start = "Write the JSON template with <final_prompt>"
    assert [b for _, b in modes(spark, [start, "a", "b", start, "c", r"\section{X}", "d"], limit=3)] == [1, 1, 1, 2, 2, 2, None]


def test_environments(spark):
    lines = [
        r"\begin{document}", "text", r"\begin{tcolorbox}[title=Key]", "prose", r"\begin{custombox}", r"\textbf{Answer:} it", "more", r"\end{custombox}", "prose", r"\end{tcolorbox}",
        r"\begin{tabular}{l}", "cell", r"\begin{verbatim}", "code", r"\end{tabular}", "text", r"\end{verbatim}", "% \\begin{verbatim}", "text", r"\begin{a}\begin{lstlisting}", "x", r"\end{a}", "text",
    ]
    want = "body body mark body mark source source mark body mark mark soft mark hard mark body mark body body mark hard hard body".split()
    found = modes(spark, lines)
    assert [m for m, _ in found] == want
    assert [b for _, b in found][5:8] == [1, 1, 1] and found[13][1] == 2 and found[20][1] == 3
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert [(r["id"], r["mode"], r["environment"], r["depth"]) for r in line_modes(df, "id", "text").orderBy("id").collect()] == [(1, "body", "body", 0), (2, "body", "body", 0)]


def test_prose(spark):
    cases = {
        r"\compactbullet{If \(m\) is odd, then it holds. Hence the bound.}": "If is odd, then it holds. Hence the bound.",
        r"Plain words \citep[see][p.~1]{long_key} go on \ref{fig:x}.": "Plain words go on .",
        r"\textcolor{deepblue}{Shown} \href{http://a.b}{link}": "Shown",
        r"\item [Label words] then": "Label words then",
        r"\texttt{a {b {c \} d}} e} left \url{http://x y} \cmd{z}": "left",
        r"\begin{itemize}[x=1] a $b$ $$c$$ \[d\] \end{itemize}": "a",
        r"Run\footnote{vllm 0.6.3 dev12} it\footnote{As shown in section 1.2.3 of the text}": "Run it As shown in section 1.2.3 of the text",
        "": "",
    }
    squeezed = F.trim(F.regexp_replace(P.prose("x"), r"\s+", " "))
    assert values(spark, [*cases, None], squeezed) == [*cases.values(), ""]


def test_name_lists(spark):
    lists = [
        (r"\item \textbf{Coding}: DeepSWE~\citep{a}, ProgramBench~\citep{b}, Terminal-Bench~2.1~\citep{c}, and SciCode~\citep{d}.", True),
        (r"GPT-4~\cite{a}, LLaMA~\cite{b}, Qwen2.5~\cite{c}", True),
        (r"GPT-4~\cite{a}. LLaMA~\cite{b}, Qwen2.5~\cite{c}", False),
        (r"GPT-4~\cite{a}, LLaMA~\cite{b} outperforms, Qwen2.5~\cite{c}", False),
        (r"GPT-4~\cite{a} LLaMA~\cite{b} Qwen2.5~\cite{c} Yi~\cite{d}", False),
        (r"apple~\cite{a}, pear~\cite{b}, plum~\cite{c}", False),
        (r"GPT-4~\cite{a}, LLaMA~\cite{b}", False),
        ("", False),
        (None, False),
    ]
    assert values(spark, [x for x, _ in lists], P.name_catalog("x")) == [w for _, w in lists]
    head = r"\paragraph{Models we use} GPT-4o, LLaMA-3, Qwen2.5, Yi-34B, Gemma2, Phi-3"
    cases = [(head, "我们使用的模型 GPT-4o"), (head, "Models"), (head.replace("Yi-34B", "which is good"), "我们使用的模型"), ("GPT-4o, LLaMA-3, Qwen2.5, Yi-34B, Gemma2", "我们使用的模型")]
    assert values(spark, cases, P.headed_names("x", "y")) == [True, False, False, False]


def test_clauses(spark):
    mixed = "该系统显著优于独立生成器和 the agentic baseline on 所有基准测试。"
    kept = [
        "我们遵循 Values in the Wild 和 LongBench v2 的评估设置。",
        r"系统使用 \textit{first care, then order, then the business of it} 作为示例说明。",
        "输入句子为：``Here we see that constraints make it better than this'' 作为示例。",
        r"调用 \texttt{book(restaurant, of the date, time, guests)} 完成操作步骤。",
        r"这类任务（即 look\_at\_obj\_in\_light）提升了很多倍。",
        r"\fbresult{the score from a failed check on one field} 这里是说明文字。",
        "下面规则必须严格执行：Do NOT renumber the documents as they are in it\\\\",
        "we show that the model works",
        "",
        None,
    ]
    found = values(spark, [mixed, "中文中文中文 we show that the model works 。", *kept], F.transform(G.english_clauses("x"), lambda c: c["words"]))
    assert found == [[4], [6]] + [[]] * len(kept)


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd é") for _ in range(r.randrange(40))) for _ in range(2))
        assert G.common_length(a, b) == brute_common(a, b)
        exact = 2 * brute_common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert G.similarity(a, b) == pytest.approx(exact)
        assert G.similarity(a, b, 0.9) in (0.0, pytest.approx(exact)) and (exact < 0.9 or G.similarity(a, b, 0.9) == pytest.approx(exact))


def test_verdicts(spark):
    prose = "This paragraph explains the training method and the evaluation protocol used throughout the paper."
    drawing = r"\fill[#1] ([shift={(0,2)}]path picture bounding box.south west) rectangle (1,1);"
    names = r"DeepSWE~\citep{a}, ProgramBench~\citep{b}, SciCode~\citep{c}."
    cases = [
        (prose, prose, "script"), (prose, "本段解释了全文采用的训练方法和评估协议。", ""), (r"\section{GPT-4o}", r"\section{GPT-4o}", ""), ("Similarly, we have", "Similarly, we have", "copy"),
        ("Finally, for this case, we have", "Finaly, for this case, we have", "copy"), ("Finally, for this case, we have", "Nothing of that sort at all", ""),
        (prose, "该系统显著优于独立生成器和 the agentic baseline on 所有基准测试。", "clause"), (drawing, drawing, ""), ("grid/.style={cell, minimum width=16pt,", "grid/.style={cell, minimum width=16pt,", ""),
        (names, names, ""), (BLOCK, BLOCK, ""), ("[width=3cm, height=2cm, of=the thing]", "[width=3cm, height=2cm, of=the thing]", ""), (prose, "429 Client Error: too many", "failed"), (prose, None, "failed"),
        (None, "文字", ""), (r"\textbf{\textcolor{deepblue}{SU-01} w/ TTS}", r"\textbf{\textcolor{deepblue}{SU-01} 带 TTS}", ""), ("已经翻译的中文文字 stays here", "已经翻译的中文文字 stays here", ""),
    ]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, source string, response string").selectExpr("*", "1 AS verdict", "2 AS kept")
    out = G.with_verdict(df)
    # a copy of long prose is refused for either reason; the copy is named where it is exact
    want = [w if (s, r) != (prose, prose) else "copy" for s, r, w in cases]
    rows = out.orderBy("i").collect()
    assert [r["verdict"] for r in rows] == want and {r["kept"] for r in rows} == {2}


def test_normal_responses(spark):
    cases = [
        (r"Trajectory Generation for \ourmethod{}", r"\section{针对\ourmethod{}的轨迹}", r"针对\ourmethod{}的轨迹"),
        (r"Trajectory for \ourmethod{}", "\\section{针对\\ourmethod{}}\n额外正文。", "\\section{针对\\ourmethod{}}\n额外正文。"),
        (r"Trajectory", r"\section{轨迹}\subsection{额外}", r"\section{轨迹}\subsection{额外}"),
        (r"Trajectory~\citep{cold}", r"\section{轨迹}", r"\section{轨迹}"),
        (r"\caption{Trajectory}", r"\section{轨迹}", r"\section{轨迹}"),
        (r"See the section \cite{a}.", r"见第 \section \cite{a}。", r"见第 章节 \cite{a}。"),
        (r"See the section.", r"见第 \section 和 \subsection。", r"见第 \section 和 \subsection。"),
        (r"\section{Method}", r"\section", r"\section"),
        (r"\emph{Merge.\par", r"\emph{合并。\par} ", r"\emph{合并。\par "),
        (r"\item a", r"\item 甲}", r"\item 甲"),
        (r"a", r"甲 \} }", r"甲 \} "),
        ("", r"\section{x}", r"\section{x}"),
        (None, None, ""),
    ]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, source string, response string")
    assert [r["normal"] for r in G.with_normal_response(df).orderBy("i").collect()] == [w for *_, w in cases]


def test_citation_multiset(spark):
    source = r"VERL~\citep[see][p.~1]{verl} is compared with SGLang~\citep{sglang}."
    reordered = r"我们比较 SGLang~\citep{sglang} 与 VERL~\citep[参见][第~1 页]{verl}。"
    bad = [r"仅 SGLang~\citep{sglang}。", reordered + r"\citep{sglang}", reordered.replace(r"\citep[", r"\citet["), reordered.replace("第~1", "第~2"), reordered.replace("{verl}", "{Verl}")]
    found = values(spark, [(source, r) for r in [reordered, *bad]], G.invalid_reason("x", "y"))
    assert found == [""] + ["citation_structure_mismatch"] * 5
    code = [(r"a \texttt{\section{x} \cite{b}}", "甲"), ("a % \\section{x}", "甲")]
    assert values(spark, code, G.invalid_reason("x", "y")) == ["", ""]


def test_logs(spark):
    done = "\nOutput written on main.xdv (3 pages)."
    long = "LaTeX Warning: Reference `fig:" + "a" * 100 + "' on page 1 undefined on input line 3."
    wrapped = "\n".join(long[i : i + 79] for i in range(0, len(long), 79))
    logs = {
        1: "x\nLaTeX Warning: Reference `fig:a' on page 1 undefined on input line 3." + done,
        2: "! Undefined control sequence.\nl.3 \\pdfoutput" + done,
        3: "! Undefined control sequence.\nl.3 \\foo" + done,
        4: wrapped + done,
        5: "LaTeX Warning: Citation `k' on page 1 undefined on input line 3." + done,
        6: "Package natbib Warning: Citation `k' on page 1 undefined on input line 3." + done,
        7: "! Missing number, treated as zero.",
        8: None,
        9: "! Undefined control sequence.\nl.3 \\pdfinfo" + "\n" * 400 + "! Undefined control sequence.\nl.9 \\bar" + done.replace("\n", "\r\n"),
        10: "a" * 79 + "\n" + "LaTeX Warning: There were undefined references." + done,
    }
    df = spark.createDataFrame(list(logs.items()), "run int, log string")
    rows = {r["run"]: r for r in L.health(df).collect()}
    strict = {r["run"]: r["healthy"] for r in L.health(df, strict=True).collect()}
    assert {k for k, r in rows.items() if r["healthy"]} == {1, 2, 4, 5, 6, 10} and {k for k, ok in strict.items() if ok} == {2, 6}
    assert {k for k, r in rows.items() if r["stale_only"]} == {1, 4, 10}
    assert rows[9]["failures"] == ["undefined control sequence"] and rows[9]["warnings"] == ["pdftex primitive undef"] and not rows[8]["complete"]
    assert sorted(map(tuple, L.warned(df).collect())) == [(1, "reference", "fig:a"), (4, "reference", "fig:" + "a" * 100), (5, "citation", "k"), (6, "citation", "k")]
    labels = spark.createDataFrame([(1, "fig:a"), (4, "fig:b"), (5, "k")], "run int, label string")
    assert {r["run"] for r in L.needs_only_another_run(df, labels).filter("reruns").collect()} == {1, 10}
    assert [tuple(r) for r in L.missing_labels(df, labels).collect()] == [(4, "fig:" + "a" * 100)]


def brute_sections(labels):
    """(label, is source) in order: what is open after each."""
    out, now = [], None
    for label, source in labels:
        if now and label != now and not label.startswith(now + ".") and label.count(".") <= now.count("."):
            now = None
        now = label if source else now
        out.append(now)
    return out


def test_sections(spark):
    pages = [(1, 1, "A Task Examples\ntext"), (1, 2, "more"), (1, 3, "A.1 Meta Prompts\nx\nA.1.3 Other things"), (1, 4, "A.2 Results here"), (1, 5, "B Details of it"), (2, 1, "A.1 Meta Prompts\n"), (2, 2, "B.1.1 Deep one"), (2, 3, "A.1.2 Own\nC Next thing"), (3, 1, None)]
    found = {(r["id"], r["pos"]): (r["before"], r["after"], r["source"]) for r in A.page_sections(spark.createDataFrame(pages, "id int, pos int, line string"), "id").collect()}
    assert found == {
        (1, 1): (None, "A", True), (1, 2): ("A", "A", True), (1, 3): ("A", "A.1", True), (1, 4): ("A.1", None, True), (1, 5): (None, None, False),
        (2, 1): (None, "A.1", True), (2, 2): ("A.1", "A.1", True), (2, 3): ("A.1", None, True), (3, 1): (None, None, False),
    }
    r = random.Random(6)
    given, rows = {}, []
    for key in range(40):
        given[key] = [(".".join([r.choice("AB"), *map(str, (r.randrange(1, 3) for _ in range(r.randrange(3))))]), r.random() < 0.4) for _ in range(r.randrange(1, 15))]
        rows += [(key, i // 3, f"{label} {'Task Examples' if s else 'Plain Results'}") for i, (label, s) in enumerate(given[key])]
    text = spark.createDataFrame(rows, "id int, pos int, line string").groupBy("id", "pos").agg(F.array_join(F.collect_list("line"), "\n").alias("line"))
    marked = A.open_sections(A.headings(text, "id"), "id").orderBy("id", "pos", "nth").collect()
    for key, labels in given.items():
        own = [m for m in marked if m["id"] == key]
        now = dict(zip([(m["pos"], m["nth"]) for m in own], [m["open"] for m in own]))
        order = [m["label"] for m in own]
        source = [m["source"] for m in own]
        assert list(now.values()) == brute_sections(list(zip(order, source)))
