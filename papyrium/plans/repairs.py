"""Queries of the text repairs: TeX with known faults is made of every whole document, and repaired.

Each returns doc_id, n (places changed) and the hash of the repaired text, which SQL makes from the document directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repairs as P
from ..functions import rewrites as R
from .common import load

_WORDS = r"[a-z]+"


def _shown(docs, repaired):
    done = docs.select("doc_id", repaired.alias("r"))
    return done.select("doc_id", F.col("r.n").cast("long").alias("n"), F.sha2("r.text", 256).alias("repaired"))


def _text():
    return F.coalesce("text", F.lit(""))


def _words():
    return F.regexp_extract_all(_text(), F.lit(_WORDS), F.lit(0))


def _cite(words):
    return F.concat(F.lit("\\cite{"), F.array_join(words, ","), F.lit("}"))


def text_words(spark, d):
    """Words before a comma or stop made commands."""
    tex = F.regexp_replace(_text(), r" ([A-Z][a-z]{1,40})(?=[,.])", r" \\text$1")
    return _shown(load(spark, d, "documents"), P.embolden_text_words(tex))


def layout_words(spark, d):
    """Capitalised words at line starts glued to a layout command."""
    tex = F.regexp_replace(_text(), r"\n([A-Z][a-z]{1,40})(?=[ ,.])", "\n" + r"\\par$1")
    return _shown(load(spark, d, "documents"), P.space_layout_words(tex))


def spaced_script(spark, d):
    """Spaces between characters of the script."""
    return _shown(load(spark, d, "documents"), R.collapse_spaced_cjk(F.replace(_text(), F.lit(" "), F.lit("中 文"))))


def unmatched_ends(spark, d):
    """Line ends as ends of environments that never began."""
    tex = F.replace(_text(), F.lit("\n"), F.lit("\\end{a}"))
    return _shown(load(spark, d, "documents"), R.lifted(R.drop_unmatched_ends)(tex))


def long_citations(spark, d):
    """All words of a document as one citation."""
    return _shown(load(spark, d, "documents").filter(F.size(_words()) > 0), R.lifted(R.split_long_citations)(_cite(_words())))


def missing_citations(spark, d):
    """All words cited, only those of more than five letters in the bibliography."""
    entries = F.array_join(F.transform(F.filter(_words(), lambda w: F.length(w) > 5), lambda w: F.concat(F.lit("\\bibitem{"), w, F.lit("}"))), "\n")
    return _shown(load(spark, d, "documents"), P.mark_missing_citations(_cite(_words()), entries))


def citation_order(spark, d):
    """Distinct cited words in order of their first place, as rows of an auxiliary file."""
    docs = load(spark, d, "documents").filter(F.size(_words()) > 0)
    tex = F.concat(_cite(_words()), F.lit("\\bibliography{refs}"))
    return docs.select("doc_id", F.size(P.cited_keys(tex)).cast("long").alias("n"), F.sha2(P.citation_aux(tex), 256).alias("repaired"))


def aux_rows(spark, d):
    """Lines as list entries, labels and other rows of an auxiliary file, in turn."""

    def row(line, i):
        label = F.concat(F.lit("\\newlabel{"), i.cast("string"), F.lit("}{{"), F.length(line).cast("string"), F.lit("}{"), i.cast("string"), F.lit("}{"), line, F.lit("}}"))
        return F.when(i % 3 == 0, F.concat(F.lit("\\@writefile{"), line, F.lit("}"))).when(i % 3 == 1, label).otherwise(line)

    return _shown(load(spark, d, "documents"), P.compact_aux(F.array_join(F.transform(F.split(_text(), "\n"), row), "\n")))


def label_lists(spark, d):
    """The first words of a document as labels: one list of defined ones, and one with a word that isn't."""
    w = F.slice(F.array_distinct(F.slice(_words(), 1, 50)), 1, 3)
    docs = load(spark, d, "documents").select("doc_id", w.alias("w")).filter(F.size("w") == 3)
    a, b, c = (F.get("w", F.lit(k)) for k in range(3))
    tex = F.concat(F.lit("\\label{"), a, F.lit("}\\label{"), b, F.lit("} \\ref{"), a, F.lit(", "), b, F.lit("} \\eqref{"), b, F.lit(","), c, F.lit("}"))
    return _shown(docs, P.split_label_lists(tex))


QUERIES = {
    "repair_text_words": text_words,
    "repair_layout_words": layout_words,
    "repair_spaced_script": spaced_script,
    "repair_unmatched_ends": unmatched_ends,
    "repair_long_citations": long_citations,
    "repair_missing_citations": missing_citations,
    "repair_citation_order": citation_order,
    "repair_aux_rows": aux_rows,
    "repair_label_lists": label_lists,
}

_DOCS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[a-z]+') AS w FROM documents)"
_PLACED = f"{_DOCS}, p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d)"

ORACLE_SQL = {
    "repair_text_words": rf"""{_DOCS}
SELECT doc_id, len(regexp_extract_all(t, ' [A-Z][a-z]{{1,40}}[,.]')) AS n,
  sha256(regexp_replace(t, ' ([A-Z][a-z]{{1,40}})([,.])', ' \\textbf{{\1}}\2', 'g')) AS repaired FROM d""",
    "repair_layout_words": rf"""{_DOCS}
SELECT doc_id, len(regexp_extract_all(t, '\n[A-Z][a-z]{{1,40}}[ ,.]')) AS n,
  sha256(regexp_replace(t, '\n([A-Z][a-z]{{1,40}})([ ,.])', chr(10) || '\\par \1\2', 'g')) AS repaired FROM d""",
    "repair_spaced_script": f"{_DOCS} SELECT doc_id, length(t) - length(replace(t, ' ', '')) AS n, sha256(replace(t, ' ', '中文')) AS repaired FROM d",
    "repair_unmatched_ends": f"{_DOCS} SELECT doc_id, length(t) - length(replace(t, chr(10), '')) AS n, sha256(replace(t, chr(10), '')) AS repaired FROM d",
    "repair_long_citations": rf"""{_PLACED}, c AS (
  SELECT doc_id, (pos - 1) // 3 AS k, string_agg(x, ',' ORDER BY pos) AS keys FROM p GROUP BY 1, 2)
SELECT doc_id, (count(*) > 1)::BIGINT AS n, sha256(string_agg('\cite{{' || keys || '}}', '' ORDER BY k)) AS repaired FROM c GROUP BY 1""",
    "repair_missing_citations": rf"""{_DOCS}, s AS (
  SELECT doc_id, w, list_filter(w, lambda x: length(x) > 5) AS has, list_filter(w, lambda x: length(x) <= 5) AS lacks FROM d)
SELECT doc_id, CASE WHEN len(has) = 0 THEN 0 ELSE len(list_distinct(lacks)) END AS n,
  sha256('\cite{{' || CASE WHEN len(has) = 0 OR len(lacks) = 0 THEN array_to_string(w, ',') || '}}'
    ELSE array_to_string(has, ',') || '}}\textsuperscript{{[缺失引用:' || array_to_string(lacks, ',') || ']}}' END) AS repaired FROM s""",
    "repair_citation_order": rf"""{_PLACED}, f AS (SELECT doc_id, x, min(pos) AS pos FROM p GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, sha256('\relax' || chr(10) || string_agg('\citation{{' || x || '}}' || chr(10), '' ORDER BY pos)
  || '\bibstyle{{plainnat}}' || chr(10) || '\bibdata{{refs}}' || chr(10)) AS repaired FROM f GROUP BY 1""",
    "repair_aux_rows": rf"""{_DOCS}, l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i, len(string_split(t, chr(10))) AS lines FROM d)
SELECT doc_id, count(*) FILTER (i % 3 < 2) AS n, sha256(coalesce(string_agg(
  CASE WHEN i % 3 = 1 THEN '\newlabel{{' || i || '}}{{{{' || length(line) || '}}{{' || i || '}}}}' || chr(10)
    WHEN i = lines - 1 THEN line ELSE line || chr(10) END, '' ORDER BY i) FILTER (i % 3 > 0), '')) AS repaired FROM l GROUP BY 1""",
    "repair_label_lists": rf"""{_PLACED}, f AS (SELECT doc_id, x, min(pos) AS pos FROM p WHERE pos <= 50 GROUP BY 1, 2),
g AS (SELECT doc_id, list(x ORDER BY pos) AS w FROM f GROUP BY 1 HAVING count(*) >= 3)
SELECT doc_id, 1::BIGINT AS n, sha256('\label{{' || w[1] || '}}\label{{' || w[2] || '}} \ref{{' || w[1] || '}}, \ref{{' || w[2] || '}} \eqref{{' || w[2] || ',' || w[3] || '}}') AS repaired FROM g""",
}
