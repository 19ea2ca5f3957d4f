"""What a stored translation lacks, taken from the translated TeX of the same paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CJK, _col, has_script, squeeze

# The note that a translator puts before an abstract, and the fields of a TeX file.
NOTE = r"(?s)\*?\{\\scriptsize\\textbf\{警告：.*?禁止移除或修改此警告。\}\}\s*\\\\?"
ABSTRACT = ("\\begin{abstract}", "\\end{abstract}")
KEYWORDS = r"\\keywords\{([^{}]+)\}"
BETWEEN_KEYWORDS = r"\\and|[,，;；]"
SENTENCE_END = "(?<=[。！？])"


def readable(c) -> Column:
    """A fragment of TeX as text: no note, citations or command names; links show their text, or else their address."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), NOTE, "")
    text = F.regexp_replace(text, r"\\(?:url|href)\{[^{}]*\}\{([^{}]+)\}", "$1")
    text = F.regexp_replace(text, r"\\(?:url|href)\{([^{}]*)\}(?:\{\})?", "$1")
    text = F.regexp_replace(text, r"\\cite[pt]?\{[^{}]*\}", "")
    return squeeze(F.regexp_replace(text, r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?|[{}]", ""))


def abstract_of(tex) -> Column:
    """What stands between the marks of the first abstract that ends; empty without one."""
    begin, end = (F.lit(x) for x in ABSTRACT)
    start = F.position(begin, _col(tex)) + len(ABSTRACT[0])
    to = F.position(end, _col(tex), start)
    return F.when((start > len(ABSTRACT[0])) & (to > 0), F.substr(_col(tex), start, to - start)).otherwise("")


def summary_of(c, sentences: int = 2, limit: int = 240) -> Column:
    """The first sentences of a text, or its first characters where it has none."""
    parts = F.filter(F.transform(F.split(_col(c), SENTENCE_END), lambda x: F.btrim(x)), lambda x: x != "")
    first = F.array_join(F.slice(parts, 1, sentences), "")
    return F.get(F.transform(F.array(first), lambda x: F.when(x != "", x).otherwise(F.substring(_col(c), 1, limit))), F.lit(0))


def keywords_of(tex, limit: int = 8) -> Column:
    """The first readable keywords of a TeX file; an empty array without any."""
    listed = F.split(F.regexp_extract(_col(tex), KEYWORDS, 1), BETWEEN_KEYWORDS)
    return F.coalesce(F.slice(F.filter(F.transform(listed, readable), lambda x: x != ""), 1, limit), F.array().cast("array<string>"))


def backfilled(rows: DataFrame, tex: str = "tex", abstract: str = "abstract_zh", summary: str = "summary_zh", keywords: str = "keywords_zh", script: str = CJK) -> DataFrame:
    """`rows` with abstract, summary and keywords filled from the column `tex`.

    An abstract or summary without a letter of the script is replaced if the abstract of the TeX has one; keywords are
    filled where there are none. A null TeX changes nothing. What stands there already stays as it is.
    """
    fields = rows.columns
    found = rows.withColumn("_found", F.when(F.col(tex).isNotNull(), readable(abstract_of(tex))))
    lacks = lambda c: has_script("_found", script) & ~has_script(c, script)
    bare = F.col(tex).isNotNull() & (F.coalesce(F.size(keywords), F.lit(0)) <= 0)
    named = F.when(bare & F.col(tex).rlike(KEYWORDS), keywords_of(tex)).otherwise(F.col(keywords))
    filled = {
        abstract: F.when(lacks(abstract), F.col("_found")).otherwise(F.col(abstract)),
        summary: F.when(lacks(summary), summary_of("_found")).otherwise(F.col(summary)),
        keywords: named,
    }
    return found.withColumns(filled).select(fields)
