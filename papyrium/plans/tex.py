"""Queries over TeX: source data by line, prose, slots and their verdicts, compilation logs, appendix sections.

The test tables hold no TeX: every line of `documents` gets a form by its document and place, and the queries read the
whole texts made of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import gate as G
from ..functions import prose as P
from ..functions.chunks import chunk_cap, split_chunks
from ..functions.text import NON_ASCII, squeeze
from ..operators import compile_logs as L
from ..operators import quality as Q
from ..operators import source_sections as S
from ..operators.source_blocks import line_modes
from .common import load

#: Forms of lines: what stands before and after the line (None: the line isn't kept).
SOURCE_FORMS = [
    (r"\begin{tcolorbox}[title=System Prompt]", None), (r"\begin{tcolorbox}[title=Key Insight]", None), (r"\end{tcolorbox}", None), (r"\textbf{Question:} ", ""),
    ("Write the JSON template with <final_prompt> tags: ", ""), (r"\section{Next} ", ""), (r"\begin{verbatim}", None), (r"\end{verbatim}", None),
    ("<method>{text}</method> ", ""), ("Return only the corrected code in a code block ", ""), (r"\begin{examplebox}{first}", None), (r"\end{examplebox}", None),
    (r"\begin{tabular}{ll}", None), (r"\end{tabular}", None), (r"\begin{itemize} ", ""), ("% ", ""), (r"\end{document} ", ""), (r"\begin{document}", None),
]
TEX_FORMS = [
    (r"\textcolor{deepblue}{", "}"), (r"\compactbullet{", r"} \cite{key_a,key_b}"), (r"\item [", "] tail words"), (r"See \ref{fig:one} and $a+b$ ", ""),
    (r"\begin{itemize}[leftmargin=1em] ", r" \end{itemize}"), (r"\texttt{code {nested \{ x} y} ", ""), ("", " https://example.org/a b c"), (r"\section*[short]{", "}"),
    (r"\(x_1\) ", r" \[y\] $$z$$"), (r"\url{http://a} \cmd{run {it {deep}}} ", r"~\citep[see][p.~1]{k}"),
]
SECTION_FORMS = [
    ("A Task Examples", None), ("A.1 Meta Prompts", None), ("A.1.3 Further Notes", None), ("A.2 Results", None), ("B Instructions for Judges", None), ("B.1.1 Deep Detail", None),
    ("C Limits of This", None), ("", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("", ""),
]
#: How much further the forms of a line go on than the table: the other lines stay as they are.
_MODULUS = {"source": 31, "tex": 13, "section": 53}


def _formed(forms, modulus: int, key: str = "doc_id", text: str = "text") -> Column:
    """The text with each line in its form."""

    def one(line: Column, i: Column) -> Column:
        k = (F.col(key) * 7 + i * 13) % modulus
        out = line
        for n, (before, after) in enumerate(forms):
            form = F.lit(before) if after is None else F.concat(F.lit(before), line, F.lit(after))
            out = F.when(k == n, form).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _formed_sql(forms, modulus: int) -> str:
    """doc_id, pos (from 1), raw and line of each line in its form."""
    cases = " ".join(f"WHEN {n} THEN {_quoted(b)}" + (f" || raw || {_quoted(a)}" if a is not None else "") for n, (b, a) in enumerate(forms))
    return f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
t AS (SELECT doc_id, pos, raw, CASE (doc_id * 7 + (pos - 1) * 13) % {modulus} {cases} ELSE raw END AS line FROM l)"""


_LIMIT = 25


def source_lines(spark, d):
    """What each line is: prose, or source data by its environment, its box or a printed prompt (of 25 lines at most)."""
    docs = load(spark, d, "documents").select("doc_id", _formed(SOURCE_FORMS, _MODULUS["source"]).alias("text"))
    return line_modes(docs, "doc_id", "text", limit=_LIMIT).drop("line")


def prose_probe(spark, d):
    """The prose of each line: its letters, words and text."""
    docs = load(spark, d, "documents").select("doc_id", _formed(TEX_FORMS, _MODULUS["tex"]).alias("text"))
    said = Q.lines(docs).select("doc_id", "pos", P.prose("line").alias("said"))
    words = F.size(F.regexp_extract_all("said", F.lit("[A-Za-z]{2,}"), F.lit(0)))
    return said.select("doc_id", "pos", F.regexp_count("said", F.lit("[A-Za-z]")).alias("letters"), words.alias("words"), F.md5(squeeze("said")).alias("prose_md5"))


_GREEK = "αβγδεζηθικλμ"


def _slots(spark, d):
    """The first line of each document as a slot, its answer made by the id: copied, nearly, in part or whole in another script."""
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z ]", "").alias("line"))
    source = F.concat(F.lit(r"\textbf{"), "line", F.lit(r"} \cite{some_key}"))
    words = F.split("line", " ")
    some = F.array_join(F.filter(words, lambda w, i: i % 30 != 29), " ")
    answer = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(r"\emph{"), "line", F.lit("}")))
        .when(F.col("doc_id") % 6 == 1, some)
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit(_GREEK), F.lit(r" \cite{some_key}")))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit(_GREEK + " "), F.lit("the same as this baseline on"), F.lit(" " + _GREEK)))
        .when(F.col("doc_id") % 6 == 4, F.lit("429 Client Error"))
        .otherwise(F.concat(F.lit("["), F.substring("line", 1, 20), F.lit("]")))
    )
    short = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(r"\begin{itemize} "), source)).otherwise(source)
    return docs.select("doc_id", short.alias("source"), answer.alias("response"))


def untranslated_slots(spark, d):
    return G.with_verdict(_slots(spark, d), script=NON_ASCII).select("doc_id", "verdict")


def near_copies(spark, d):
    """How much of each document's first line is left, in order, where every seventh word and all capitals are gone."""
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("a"))
    less = F.array_join(F.filter(F.split("a", " "), lambda w, i: i % (7 + F.col("doc_id") % 20) != 6), " ")
    return docs.select("doc_id", F.round(G.near_copy("a", F.regexp_replace(less, "[A-Z]", "")), 9).alias("ratio"))


def normal_responses(spark, d):
    """Answers with a slip by the id, after it is taken back; and whether they pass the structure gate then."""
    docs = load(spark, d, "documents").select("doc_id", F.substring(F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z ]", ""), 1, 40).alias("line"))
    k = F.col("doc_id") % 8
    say = lambda before, after="": F.concat(F.lit(before), "line", F.lit(after))
    source = F.when(k == 5, say(r"\caption{", "}")).when(k == 7, say("See ", r"~\citep[p.~1]{a, b}")).otherwise(say("Say: "))
    response = (
        F.when(k == 0, say("", " }"))
        .when(k == 1, say("", r" \section"))
        .when(k == 2, say(r"\subsection*{a {b} \} ", "}  "))
        .when(k == 3, say(r"\section{", "} more"))
        .when(k == 4, say("", r" \section and \paragraph"))
        .when(k == 5, say(r"\section{", "}"))
        .when(k == 6, say(r"\emph{", "}"))
        .otherwise(say("", r"~\citep[S.~1]{a,b}}"))
    )
    out = G.with_normal_response(docs.select("doc_id", source.alias("source"), response.alias("response")))
    return out.select("doc_id", "normal", G.invalid_reason("source", "normal").alias("reason"))


def _logs(spark, d):
    """A compilation log for each document, wrapped at 79 characters, and the labels of its sources."""
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z]", "").alias("w"))
    k = F.col("doc_id") % 10
    name = F.concat(F.lit("fig:"), F.substring("w", 1, 70))
    said = F.array_compact(
        F.array(
            F.lit("This is a TeX engine"),
            F.when(k.isin(1, 2, 3, 8), F.concat(F.lit("LaTeX Warning: Reference `"), name, F.lit("' on page 3 undefined on input line 12."))),
            F.when(k.isin(3, 4), F.concat(F.lit("LaTeX Warning: Citation `"), name, F.lit("' on page 1 undefined on input line 7."))),
            F.when(k == 5, F.concat(F.lit("Package natbib Warning: Citation `"), name, F.lit("' on page 1 undefined on input line 7."))),
            F.when(k == 6, "! Undefined control sequence.\nl.40 \\pdfminorversion"),
            F.when(k.isin(7, 8), "! Undefined control sequence.\nl.41 \\unknownmacro"),
            F.when(k == 9, "! Missing number, treated as zero."),
            F.when(k == 2, "LaTeX Warning: There were undefined references."),
            F.when(F.col("doc_id") % 7 != 0, "Output written on main.pdf (9 pages)."),
        )
    )
    wrapped = F.transform(said, lambda x: F.regexp_replace(x, r"([^\n]{79})", "$1\n"))
    logs = docs.select(F.col("doc_id").alias("run"), F.array_join(wrapped, "\n").alias("log"))
    labels = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("run"), name.alias("label"))
    return logs, labels


def log_health(spark, d):
    logs, _ = _logs(spark, d)
    both = L.health(logs).join(L.health(logs, strict=True).select("run", F.col("healthy").alias("strictly")), "run")
    return both.select("run", "complete", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "stale_only", "healthy", "strictly")


def log_reruns(spark, d):
    return L.needs_only_another_run(*_logs(spark, d))


def source_sections(spark, d):
    """Which pages (of twelve lines) of each document are source data by the appendix section they lie in."""
    formed = F.split(_formed(SECTION_FORMS, _MODULUS["section"]), "\n")
    steps = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 12).cast("int"))
    docs = load(spark, d, "documents").select("doc_id", formed.alias("lines"))
    paged = docs.select("doc_id", F.array_join(F.transform(steps, lambda i: F.array_join(F.slice("lines", i * 12 + 1, F.lit(12)), "\n")), "\f").alias("text"))
    return S.page_sections(Q.pages(paged), "doc_id")


def chunk_integrity(spark, d):
    """Each text's cap, whether its chunks joined in order are the text, and how many are empty or above the cap."""
    docs = load(spark, d, "documents").select("doc_id", _formed(TEX_FORMS, _MODULUS["tex"]).alias("text")).withColumn("cap", chunk_cap("text"))
    cut = docs.select("doc_id", "text", "cap", split_chunks("text", "cap").alias("chunks"))
    wrong = F.size(F.filter("chunks", lambda c: (F.char_length(c) > F.col("cap")) | (c == "")))
    return cut.select("doc_id", F.col("cap").cast("int").alias("cap"), F.md5(F.array_join("chunks", "")).alias("joined_md5"), wrong.alias("wrong"))


def name_catalogs(spark, d):
    """Lists of cited names, and sentences that look like them."""
    docs = load(spark, d, "documents").select("doc_id", F.slice(F.filter(F.split(F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z ]", ""), " "), lambda w: F.length(w) >= 3), 1, 6).alias("w"))
    k = F.col("doc_id") % 5
    named = F.array_join(F.transform("w", lambda w: F.concat(F.initcap(w), F.lit("-3.5"), F.lit(r"~\cite{k}"))), ", ")
    text = (
        F.when(k == 0, named)
        .when(k == 1, F.concat(named, F.lit(". Then more")))
        .when(k == 2, F.concat(named, F.lit(", and we compare")))
        .when(k == 3, F.array_join(F.transform("w", lambda w: F.concat(F.lower(w), F.lit(r"~\cite{k}"))), ", "))
        .otherwise(F.concat(named, F.lit(" and large-v2.")))
    )
    return docs.select("doc_id", P.name_catalog(text).alias("catalog"))


QUERIES = {
    "source_lines": source_lines,
    "prose_probe": prose_probe,
    "untranslated_slots": untranslated_slots,
    "near_copies": near_copies,
    "normal_responses": normal_responses,
    "log_health": log_health,
    "log_reruns": log_reruns,
    "source_sections": source_sections,
    "name_catalogs": name_catalogs,
    "chunk_integrity": chunk_integrity,
}

_STATE_SQL = rf"""
WITH RECURSIVE {_formed_sql(SOURCE_FORMS, _MODULUS["source"])},
c AS (SELECT doc_id, pos, regexp_replace(line, '^((?:[^%\\]|\\.)*)%.*$', '\1') AS line FROM t),
f AS (
  SELECT doc_id, pos, line,
    regexp_matches(line, '(?i)^\s*(return|output)\b.*\b(only|corrected)\b') AND regexp_matches(line, '(?i)\b(code|json|xml)\b') AND regexp_matches(line, '(?i)code\s+block') AS is_order,
    regexp_matches(line, '(?i)\b(write|return|output)\b.*<final_prompt>') AND regexp_matches(line, '(?i)\b(write|return|output)\b.*\b(json|template)\b') AS start,
    regexp_matches(line, '(?i)(\\end\{{(verbatim|lstlisting|minted|tcblisting)\}}|\\(section|subsection|subsubsection)\*?\{{)') AS stop,
    regexp_matches(line, '(?i)^\s*\\(textbf|textit|emph)\s*\{{question\s*:?\s*\}}') AS field,
    regexp_extract(line, '\\begin\{{([^}}]+)\}}', 1) AS b, regexp_extract(line, '\\end\{{([^}}]+)\}}', 1) AS e,
    regexp_matches(line, '(?i)\bsystem[\s_-]*prompt\b') OR regexp_matches(line, '\\begin\{{examplebox\}}\s*\S') AS says
  FROM c
), r AS (
  SELECT doc_id, 0::BIGINT AS pos, []::STRUCT(p VARCHAR, n VARCHAR, k INTEGER)[] AS stack, 0 AS prompt, 0 AS n, 0 AS blocks, ''::VARCHAR AS mode, NULL::INTEGER AS block, ''::VARCHAR AS environment, 0 AS depth
  FROM documents
  UNION ALL
  SELECT doc_id, pos, stack2, CASE WHEN goes THEN prompted ELSE 0 END, CASE WHEN goes THEN n1 ELSE 0 END, blocks2 + opens::INT, mode, block, environment, depth FROM (
    SELECT *, CASE WHEN b <> '' THEN list_append(stack1, {{'p': CASE WHEN b = 'verbatim' THEN 'h' WHEN b = 'tabular' THEN 's' WHEN b IN ('tcolorbox', 'examplebox') AND says THEN 'B' WHEN b IN ('tcolorbox', 'examplebox') THEN 'b' ELSE '' END,
          'n': b, 'k': CASE WHEN opens THEN blocks2 + 1 END}})
        WHEN e <> '' AND closed > 0 THEN stack1[1:closed - 1] ELSE stack1 END AS stack2,
      CASE WHEN tracked THEN 'mark' WHEN around.p = 'h' THEN 'hard' WHEN around.p = 'B' THEN 'source' WHEN prompted > 0 THEN 'prompt' WHEN inner_.p = 's' THEN 'soft' ELSE 'body' END AS mode,
      CASE WHEN around IS NOT NULL THEN around.k WHEN tracked THEN NULL WHEN prompted > 0 THEN prompted END AS block,
      coalesce(inner_.n, 'body') AS environment, len(stack1)::INT AS depth
    FROM (
      SELECT *, coalesce(list_filter(stack1, lambda x: x.p = 'h')[1], list_filter(stack1, lambda x: x.p = 'B')[1]) AS around,
        list_filter(stack1, lambda x: x.n <> 'document')[-1] AS inner_,
        b IN ('verbatim', 'tabular', 'tcolorbox', 'examplebox') OR e IN ('verbatim', 'tabular', 'tcolorbox', 'examplebox') AS tracked,
        b = 'verbatim' OR (b IN ('tcolorbox', 'examplebox') AND says) AS opens,
        coalesce(list_max(list_filter(range(1, len(stack1) + 1), lambda j: stack1[j].n = e)), 0) AS closed
      FROM (
        SELECT *, blocks1 + promotes::INT AS blocks2,
          CASE WHEN promotes THEN list_transform(stack, lambda x, j: CASE WHEN j = cand THEN {{'p': 'B', 'n': x.n, 'k': blocks1 + 1}} ELSE x END) ELSE stack END AS stack1
        FROM (
          SELECT *, field AND cand > 0 AS promotes FROM (
            SELECT *, coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda j: j > last_b AND stack[j].n IN ('tcolorbox', 'examplebox'))), 0) AS cand,
              (prompt > 0 OR (start AND NOT is_order)) AND NOT stop AND n1 < {_LIMIT} AS goes
            FROM (
              SELECT f.*, r.stack, r.prompt, CASE WHEN r.prompt > 0 THEN r.prompt WHEN f.is_order OR f.start THEN r.blocks + 1 ELSE 0 END AS prompted,
                r.blocks + (r.prompt = 0 AND (f.is_order OR f.start))::INT AS blocks1,
                CASE WHEN r.prompt > 0 OR f.is_order OR f.start THEN r.n + 1 ELSE r.n END AS n1,
                coalesce(list_max(list_filter(range(1, len(r.stack) + 1), lambda j: r.stack[j].p = 'B')), 0) AS last_b
              FROM r JOIN f ON f.doc_id = r.doc_id AND f.pos = r.pos + 1
            )
          )
        )
      )
    )
  )
)
SELECT doc_id, pos, mode, block, environment, depth FROM r WHERE pos > 0
"""


def _chain(column: str, *rules: tuple[str, str]) -> str:
    for pattern, kept in rules:
        column = f"regexp_replace({column}, {_quoted(pattern)}, '{kept}', 'g')"
    return column


_GROUP = r"\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.)*\})*\})*\}"
_SAID = _chain(
    "line",
    (r"\\(?:[A-Za-z@]*tt|cmd|path|url|nolinkurl)\*?(?:\[[^\]]*\])?" + _GROUP, " "),
    (r"(?i)https?://[^\n]*", " "),
    (r"\\textcolor\{[^{}]*\}\{([^{}]*)\}", r" \1 "),
    (r"\\item\s*\[([^\]]+)\]", r" \1 "),
    (r"(?i)\\(?:cite|citep|citet)\*?(?:\[[^\]]*\]){0,2}\{[^{}]*\}", " "),
    (r"\\(?:label|ref|eqref)\*?\{[^{}]*\}", " "),
    (r"\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", " "),
    (r"\\(?:begin|end)\{[^{}]+\}(?:\[[^\]]*\])?", " "),
    (r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " "),
    (r"[{}\\_^$&#~=+*/<>|]", " "),
)
_FIRST = "string_split(text, chr(10))[1]"
_PLAIN = f"regexp_replace({_FIRST}, '[^A-Za-z ]', '', 'g')"
_LOG = f"(SELECT doc_id AS run, doc_id % 10 AS k, 'fig:' || left(regexp_replace({_FIRST}, '[^A-Za-z]', '', 'g'), 70) AS name, doc_id % 7 <> 0 AS complete FROM documents)"
_STALE = "k IN (1, 2)"

_HEADING = r"(?m)^\s*([A-Z](?:\.\d+)*)\.?\s+([A-Z][^\n]{2,120})\s*$"
_SECTIONS = rf"""
WITH {_formed_sql(SECTION_FORMS, _MODULUS["section"])},
pt AS (SELECT doc_id, (pos - 1) // 12 + 1 AS page, string_agg(line, chr(10) ORDER BY pos) AS text FROM t GROUP BY ALL),
m AS (SELECT doc_id, page, generate_subscripts(regexp_extract_all(text, '{_HEADING}', 1), 1) AS nth, unnest(regexp_extract_all(text, '{_HEADING}', 1)) AS label, unnest(regexp_extract_all(text, '{_HEADING}', 2)) AS title FROM pt),
h AS (SELECT doc_id, 1000 * page + nth AS pos, label, regexp_matches(title, '(?i)\btask\s+examples?\b|\bmeta\s+prompts?\b|\binstructions?\s+for\b') AS src FROM m),
g AS (SELECT *, sum(src::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM h),
o AS (SELECT *, CASE WHEN grp > 0 THEN first_value(label) OVER (PARTITION BY doc_id, grp ORDER BY pos) END AS opened FROM g),
x AS (SELECT *, max((label <> opened AND NOT starts_with(label, opened || '.') AND len(string_split(label, '.')) <= len(string_split(opened, '.')))::INT) OVER (PARTITION BY doc_id, grp ORDER BY pos) AS ended FROM o),
s AS (SELECT doc_id, pos, CASE WHEN coalesce(ended, 0) = 0 THEN opened END AS now FROM x),
p AS (SELECT DISTINCT doc_id, (pos - 1) // 12 + 1 AS page FROM l),
q AS (
  SELECT p.doc_id, p.page,
    (SELECT arg_max(struct_pack(v := s.now), s.pos).v FROM s WHERE s.doc_id = p.doc_id AND s.pos < 1000 * p.page) AS before,
    (SELECT arg_max(struct_pack(v := s.now), s.pos).v FROM s WHERE s.doc_id = p.doc_id AND s.pos < 1000 * (p.page + 1)) AS after,
    EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.pos // 1000 = p.page AND s.now IS NOT NULL) AS here
  FROM p
)
SELECT doc_id, page AS pos, before, after, before IS NOT NULL OR here AS source FROM q
"""

ORACLE_SQL = {
    "source_lines": _STATE_SQL,
    "prose_probe": f"""
WITH {_formed_sql(TEX_FORMS, _MODULUS["tex"])}, s AS (SELECT doc_id, pos, {_SAID} AS said FROM t)
SELECT doc_id, pos, length(regexp_replace(said, '[^A-Za-z]', '', 'g'))::INTEGER AS letters, len(regexp_extract_all(said, '[A-Za-z]{{2,}}'))::INTEGER AS words, md5(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS prose_md5 FROM s""",
    # Every answer is made so that its verdict follows from its making and the size of the source.
    "untranslated_slots": f"""
WITH s AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[A-Za-z]{{2,}}') AS w, regexp_extract_all(array_to_string(list_filter(string_split({_PLAIN}, ' '), lambda x, i: (i - 1) % 30 <> 29), ' '), '[A-Za-z]{{2,}}') AS kept,
    {_PLAIN} AS line FROM documents),
n AS (SELECT *, length(replace(line, ' ', '')) AS letters, length(array_to_string(w, ' ')) AS a, length(array_to_string(kept, ' ')) AS b, len(w) AS words,
    length(regexp_replace(left(line, 20), '[^A-Za-z]', '', 'g')) AS head, length(array_to_string(regexp_extract_all(left(line, 20), '[A-Za-z]{{2,}}'), ' ')) AS c FROM s)
SELECT doc_id, CASE
  WHEN doc_id % 6 = 4 OR (doc_id % 6 = 1 AND trim(array_to_string(list_filter(string_split(line, ' '), lambda x, i: (i - 1) % 30 <> 29), ' '), ' ') = '') THEN 'failed'
  WHEN doc_id % 6 = 2 THEN ''
  WHEN doc_id % 6 = 3 THEN 'clause'
  WHEN doc_id % 6 = 0 THEN CASE WHEN letters >= 12 AND words >= 3 THEN 'copy' ELSE '' END
  WHEN doc_id % 6 = 1 THEN CASE WHEN letters >= 12 AND words >= 3 AND w = kept THEN 'copy'
      WHEN letters >= 40 AND words >= 6 AND length(regexp_replace(array_to_string(list_filter(string_split(line, ' '), lambda x, i: (i - 1) % 30 <> 29), ' '), '[^A-Za-z]', '', 'g')) >= 24 THEN 'script'
      WHEN letters >= 12 AND words >= 3 AND 2.0 * b / (a + b) >= 0.92 AND length(array_to_string(kept, '')) >= 10 THEN 'copy' ELSE '' END
  ELSE CASE WHEN letters >= 12 AND words >= 3 AND head >= 10 AND 2.0 * c / (a + c) >= 0.92 THEN 'copy' ELSE '' END END AS verdict FROM n""",
    # What is left of a text after words and letters went is a subsequence of it, hence the longest that both have.
    "near_copies": f"""
WITH s AS (SELECT doc_id, {_FIRST} AS a, regexp_replace(array_to_string(list_filter(string_split({_FIRST}, ' '), lambda x, i: (i - 1) % (7 + doc_id % 20) <> 6), ' '), '[A-Z]', '', 'g') AS b FROM documents),
r AS (SELECT doc_id, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * length(b) / (length(a) + length(b)) END AS x FROM s)
SELECT doc_id, round(CASE WHEN x >= 0.92 THEN x ELSE 0 END, 9) AS ratio FROM r""",
    "normal_responses": f"""
WITH s AS (SELECT doc_id, doc_id % 8 AS k, left({_PLAIN}, 40) AS line FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN line || ' ' WHEN 1 THEN line || ' 章节' WHEN 2 THEN 'a {{b}} \\}} ' || line WHEN 3 THEN '\\section{{' || line || '}} more' WHEN 4 THEN line || ' \\section and \\paragraph'
    WHEN 5 THEN '\\section{{' || line || '}}' WHEN 6 THEN '\\emph{{' || line || '}}' ELSE line || '~\\citep[S.~1]{{a,b}}' END AS normal,
  CASE WHEN k IN (3, 4, 5) THEN 'critical_latex_structure_mismatch' ELSE '' END AS reason FROM s""",
    "log_health": f"""
SELECT run, complete, CASE WHEN k IN (7, 8) THEN 'undefined control sequence' WHEN k = 9 THEN 'missing number' ELSE '' END AS failures,
  CASE WHEN k IN (1, 8) THEN 'undefined reference' WHEN k = 2 THEN 'undefined reference,undefined references' WHEN k = 3 THEN 'undefined citation,undefined reference'
    WHEN k = 4 THEN 'undefined citation' WHEN k = 5 THEN 'natbib undefined' WHEN k = 6 THEN 'pdftex primitive undef' ELSE '' END AS warnings,
  {_STALE} AS stale_only, complete AND k NOT IN (7, 8, 9) AS healthy, complete AND k IN (0, 5, 6) AS strictly FROM {_LOG}""",
    "log_reruns": f"SELECT run, {_STALE} AND run % 3 = 0 AS reruns FROM {_LOG}",
    "source_sections": _SECTIONS,
    # What a chunking must keep, not how it cuts.
    "chunk_integrity": rf"""
WITH {_formed_sql(TEX_FORMS, _MODULUS["tex"])}, w AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN regexp_matches(text, '\\(ref|label)\{{') THEN 350 WHEN len(regexp_extract_all(text, '\\cite[pt]?(?:\[[^\]]*\])*\{{')) >= 2 THEN 120 ELSE 1200 END AS cap, md5(text) AS joined_md5, 0 AS wrong FROM w""",
    "name_catalogs": f"""
WITH s AS (SELECT doc_id, len(list_filter(string_split({_PLAIN}, ' '), lambda x: length(x) >= 3)[1:6]) AS n FROM documents)
SELECT doc_id, n >= 3 AND doc_id % 5 IN (0, 4) AS catalog FROM s""",
}
