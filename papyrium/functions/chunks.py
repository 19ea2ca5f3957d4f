"""Chunks: caps, bounded splitting and coalescing of text for translation requests.

Splitting and coalescing are order-dependent within a text, so they run as Arrow-batched Python functions
over rows; everything across rows stays in DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col, unescape_entities

DEFAULT_CAP, REFERENCE_CAP, CITATION_CAP, MIN_SENTENCE = 1200, 350, 120, 180

# Commands whose arguments are citation keys or labels.
CITATION = r"(?i)\\(?:cite|citep|citet|citealp|citeauthor|citeyear|parencite|textcite)\*?(?:\[[^\]]*\]){0,2}\{[^{}]*\}"
REFERENCE = r"\\(?:ref|eqref|autoref|cref|Cref|pageref|label)\*?\{[^{}]*\}"
HEADING = r"\\(?:section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{"


def chunk_cap(c, default: int = DEFAULT_CAP) -> Column:
    """The most characters of a chunk: few where references or several citations must survive."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(F.regexp_count(c, F.lit(REFERENCE)) >= 1, min(default, REFERENCE_CAP)).when(F.regexp_count(c, F.lit(CITATION)) >= 2, min(default, CITATION_CAP)).otherwise(default)


_MARK = re.compile(r"\\.?|[{}$]", re.DOTALL)


def _depths(text: str) -> bytearray:
    """For each boundary 0..n whether a cut there is safe: outside braces and inline math, not after a backslash."""
    safe, depth, math, start = bytearray(b"\1") * (len(text) + 1), 0, False, 0
    for m in _MARK.finditer(text):
        at, kind = m.start(), text[m.start()]
        if kind == "\\":
            safe[at + 1] = 0
            continue
        was = depth or math
        if kind == "{":
            depth += 1
        elif kind == "}":
            depth = max(0, depth - 1)
        else:
            math = not math
        if not was and (depth or math):
            start = at + 1
        elif was and not (depth or math):
            safe[start : at + 1] = bytes(at + 1 - start)
    if depth or math:  # up to the last boundary, where a text may end
        safe[start:-1] = bytes(len(text) - start)
    return safe


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？；])")
_BLANK = re.compile(r"\s+")


def split_bounded(text: str | None, cap: int, min_sentence: int = MIN_SENTENCE) -> list[str]:
    """Pieces of at most `cap` characters whose concatenation is the text.

    A piece ends at a heading, at the last sentence end that leaves `min_sentence` characters, else at
    white space, else anywhere; never within braces or math unless a single group is longer than the cap.
    """
    if not text:
        return []
    units, at = [], 0
    for m in re.finditer(HEADING, text):
        if m.start() > at:
            units.append(text[at : m.start()])
            at = m.start()
    units.append(text[at:])
    out = []
    for unit in units:
        safe = _depths(unit)
        a = 0
        while len(unit) - a > cap:
            best = None
            for pattern, least in ((_SENTENCE, min(min_sentence, cap // 2)), (_BLANK, 1)):
                ends = [m.end() for m in pattern.finditer(unit, a, a + cap) if m.end() - a >= least and safe[m.end()]]
                if ends:
                    best = ends[-1]
                    break
            if best is None:
                best = next((i for i in range(a + cap, a, -1) if safe[i]), a + cap)
            out.append(unit[a:best])
            a = best
        if a < len(unit):
            out.append(unit[a:])
    return out


def coalesce_fragments(fragments: list[tuple[str, bool]], cap: int = DEFAULT_CAP) -> list[tuple[str, bool]]:
    """Neighbours of one kind are joined while they stay within the cap; white space between two
    translated fragments is bridged; a heading always begins a fragment of its own."""
    out: list[tuple[str, bool]] = []
    for text, preserve in fragments:
        if not text:
            continue
        if not text.strip() and out:
            out[-1] = (out[-1][0] + text, out[-1][1])
            continue
        heading = not preserve and re.match(HEADING, text.lstrip())
        if out and out[-1][1] == preserve and not heading and (preserve or len(out[-1][0]) + len(text) <= cap):
            out[-1] = (out[-1][0] + text, preserve)
        else:
            out.append((text, preserve))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chunks(texts, caps):
    import pandas as pd

    return pd.Series([split_bounded(t, int(c)) for t, c in zip(texts, caps)])


#: A fragment on the page of a splitter, and the range before it.
NODE = r'(?s)<p style="color:(red|black);">(.*?)</p>'
NODE_RANGE = r"^#\[[^\]]+\]"


def splitter_nodes(c) -> Column:
    """Fragments (text, preserve) of a splitter's page, in order: red paragraphs are preserved, black ones translated."""
    red, black = ('<p style="color:%s;">' % x for x in ("red", "black"))
    found = F.regexp_extract_all(_col(c), F.lit(NODE), F.lit(0))  # whole, so that the page is made and read once

    def node(x: Column) -> Column:
        kept = F.startswith(x, F.lit(red))
        skip = F.when(kept, len(red)).otherwise(len(black))
        body = F.substr(x, skip + 1, F.length(x) - skip - len("</p>"))
        text = F.regexp_replace(unescape_entities(F.replace(body, F.lit("<br/>"), F.lit("\n"))), NODE_RANGE, "")
        return F.struct(F.regexp_replace(text, r"#\z", "").alias("text"), kept.alias("preserve"))

    return F.transform(found, node)
