"""What of a TeX fragment a reader would read: prose without payloads, and lists of names that are no prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import CITATION
from .source_data import fragment
from .text import CJK, _col, script_chars


def group(depth: int = 4) -> str:
    """The pattern of a braced group with up to `depth` levels of groups inside; escaped braces are characters."""
    inside = r"(?:[^{}\\]|\\[\s\S])*+"
    for _ in range(depth):
        inside = rf"(?:[^{{}}\\]|\\[\s\S]|\{{{inside}\}})*+"
    return rf"\{{{inside}\}}"


# What stands in TeX and is not said, in the order in which it goes, and what stays of it.
_CODE = r"\\(?:[A-Za-z@]*tt|cmd|path|url|nolinkurl)\*?(?:\[[^\]]*\])?"
_REFERENCE = r"(?i)\\(?:label|ref|eqref|pageref|autoref|cref)\*?(?:\[[^\]]*\]){0,2}\{[^{}]*\}"
_MATH = r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]"
_VERSION_NOTE = r"\\footnote\{(?=(?:[^{}0-9]*[0-9]){3})(?=[^{}]*(?i:vllm|cuda|dev\d+|[v-]?\d+\.\d+|\+[a-f0-9]{6,}))(?!(?:[^{}]*?\b[a-z]{2,}\b){3})[^{}]*\}"
UNSAID = (
    (_CODE + group(), " "),
    (r"(?i)https?://[^\n]*", " "),
    (r"\\(?:textcolor|colorbox|href)\*?(?:\[[^\]]*\])?\{[^{}]*\}\{([^{}]*)\}", " $1 "),
    (_VERSION_NOTE, " "),
    (r"\\item\s*\[([^\]]+)\]", " $1 "),
    (CITATION, " "),
    (_REFERENCE, " "),
    (_MATH, " "),
    (r"\\(?:begin|end)\{[^{}]+\}(?:\[[^\]]*\])?", " "),
    (r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " "),
    (r"[{}\\_^$&#~=+*/<>|]", " "),
)
# What a paper quotes and doesn't say itself.
_QUOTED = (
    (r"(?i)\\(?:fbtask|fbtraj|fbresult)\*?(?:\[[^\]]*\])?" + group(), " "),
    (r"\\(?:emph|textit|texttt|verb)\*?(?:\[[^\]]*\])?" + group(2), " "),
    (r"\b[A-Za-z0-9]+(?:\\_[A-Za-z0-9]+)+\b", " "),
    ('["“][^"”\n]*["”]', " "),
    (r"(?s)``.*?''", " "),
)
_TEMPLATE_LINE = r"(?i)(?:\bdo\s+not\s+renumber\b|\b(?:rules|rubrics|output\s+format|doc\s+set)\s*:|\b(?:query|answer)\s*:)"
WORD = r"\b[A-Za-z][A-Za-z'-]{1,}\b"


def unsaid(c: Column, rules) -> Column:
    """A text after rules of (pattern, what stays), each over the whole."""
    for pattern, kept in rules:
        c = F.regexp_replace(c, pattern, kept)
    return c


def prose(c) -> Column:
    """A fragment's prose: commands go, the text in their arguments stays, payloads (code, keys, formulas) go whole."""
    return unsaid(fragment(c), UNSAID)


def own_prose(c) -> Column:
    """As prose, but without what is quoted: examples, emphasised names, identifiers; nothing of a prompt set with line breaks."""
    c = fragment(c)
    template = F.contains(c, F.lit("\\\\")) & c.rlike(_TEMPLATE_LINE)
    return F.when(template, "").otherwise(unsaid(unsaid(c, _QUOTED), UNSAID))


def prose_words(c) -> Column:
    """The words of a prose probe, in lower case."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


# Words of names, words that only sentences have, and words between names.
NAME_WORDS = ("audio", "base", "chat", "flash", "instruct", "large", "medium", "mini", "model", "omni", "pro", "small", "turbo")
SENTENCE_WORDS = (
    "achieve", "achieves", "are", "compare", "compares", "evaluate", "evaluates", "include", "includes", "is", "outperform", "outperforms",
    "propose", "proposes", "report", "reports", "show", "shows", "use", "uses", "were",
)
LINK_WORDS = ("and", "or", "plus", "with")

_COMMAND = r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?"
_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-_+][A-Za-z0-9]+|(?<=[0-9])\.(?=[0-9])[A-Za-z0-9]+)*"
_NUMBER = r"[0-9](?:[A-Za-z0-9]|\.(?=[0-9]))*"


def _kinds(c: Column, commands: bool) -> Column:
    """A letter for each piece of a list: Citation, Name, Link, word of a sentence (W), other word (w), separator (,), stop (.)."""
    piece = "|".join([f"(?:{CITATION.removeprefix('(?i)')})", r"\$[^$]*\$", *([_COMMAND] if commands else []), _TOKEN, _NUMBER, r"[,;\n]", "[.!?]"])
    pieces = F.regexp_extract_all(c, F.lit("(?i)" + piece), F.lit(0))

    def kind(x: Column) -> Column:
        low = F.lower(x)
        return (
            F.when(x.rlike(r"^\\(?i:cite|parencite|textcite)"), "C")
            .when(x.rlike(r"^[$\\0-9]"), "")
            .when(x.isin(",", ";", "\n"), ",")
            .when(x.isin(".", "!", "?"), ".")
            .when(low.isin(*LINK_WORDS), "L")
            .when(low.isin(*SENTENCE_WORDS) & (x == low), "W")
            .when(low.isin(*NAME_WORDS) | x.rlike("[A-Z0-9_.+-]"), "N")
            .otherwise("w")
        )

    return F.array_join(F.transform(pieces, kind), "")


def _of(kinds: Column, letters: str) -> Column:
    return F.char_length(kinds) - F.char_length(F.translate(kinds, letters, ""))


def _names(kinds: Column, words: Column, ratio: float) -> Column:
    return (_of(kinds, "W") == 0) & (_of(kinds, "N") >= words * F.lit(ratio))


def name_catalog(c, least_citations: int = 3, ratio: float = 0.8) -> Column:
    """Whether a text is a list of cited names and says nothing: names between separators, about as many as citations,
    no word that only a sentence has, and no stop but at the end."""
    kinds = _kinds(unsaid(fragment(c), UNSAID[:2]), commands=True)
    cited, words = _of(kinds, "C"), _of(kinds, "NWw")
    return (cited >= least_citations) & ~kinds.rlike(r"\.(?!$)") & (_of(kinds, ",") >= cited - 2) & words.between(cited, cited * 4 + 3) & _names(kinds, words, ratio)


def headed_names(source, response, script: str = CJK, ratio: float = 0.8) -> Column:
    """Whether a source is a short heading before a list of names, and the response holds the heading in the script."""
    source = F.coalesce(_col(source), F.lit(""))
    headed = r"(?s)^\s*\\(?:paragraph|subparagraph)\*?\{[^{}]*\}\s*(.*)$"
    kinds = _kinds(F.regexp_replace(F.regexp_extract(source, headed, 1), _MATH, " "), commands=False)
    words = _of(kinds, "NWwL")
    said = F.coalesce(script_chars(response, script), F.lit(0)) >= 4
    return source.rlike(headed) & said & (_of(kinds, ",") >= 4) & (words >= 5) & _names(kinds, words, ratio)
