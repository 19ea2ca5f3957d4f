"""Scalar text functions: scripts, cleaning, terms, slugs, responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"
NON_ASCII = "[^\\x00-\\x7F]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters(c) -> Column:
    return F.regexp_count(_col(c), F.lit("[A-Za-z]"))


def script_chars(c, script: str = CJK) -> Column:
    return F.regexp_count(_col(c), F.lit(script))


def tokens(c) -> Column:
    """ASCII words of three characters or more, hyphens within; no word boundaries asked for."""
    return F.regexp_extract_all(_col(c), F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0))


def words_bounded(c) -> Column:
    """As tokens, between word boundaries: a letter of another script beside them is one of theirs."""
    return F.regexp_count(_col(c), F.lit(r"(?U)\b[A-Za-z][A-Za-z-]{2,}\b"))


def script_share(c, script: str = CJK) -> Column:
    """100 * script characters / (script characters + ASCII letters), 0 for neither; not rounded."""
    s, a = script_chars(c, script), letters(c)
    return 100.0 * s / F.greatest(s + a, F.lit(1))


def has_script(c, script: str = CJK) -> Column:
    return F.coalesce(_col(c).rlike(script), F.lit(False))


def squeeze(c) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.btrim(F.regexp_replace(_col(c), r"\s+", " "))


def strip_comment(c) -> Column:
    """A line up to its first unescaped percent sign."""
    return F.regexp_replace(_col(c), r"(?m)^((?:[^%\\\n]|\\.)*+)%.*$", "$1")


def brace_balance(c) -> Column:
    """Opening minus closing braces, escaped ones and comments left aside."""
    bare = F.regexp_replace(strip_comment(c), r"\\.", "")
    return F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def unescape_entities(c) -> Column:
    """The five named entities of markup, the ampersand last."""
    c = _col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_entities(c) -> Column:
    c = _col(c)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def slug(c, limit: int = 60, default: str = "topic") -> Column:
    """Lower case with hyphens for all but a-z, 0-9, _ and -."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9_-]+", "-")
    x = F.substring(F.btrim(F.regexp_replace(x, "-{2,}", "-"), F.lit("-")), 1, limit)
    return F.when(x == "", F.lit(default)).otherwise(x)


def display_filename(c, limit: int = 80, default: str = "paper") -> Column:
    """A file name without separators, control and reserved characters."""
    x = squeeze(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r'[\x00-\x1f\\/:*?"<>|]+', " "))
    x = F.trim(F.substring(x, 1, limit))
    return F.when(x == "", F.lit(default)).otherwise(x)


def term_tokens(term: Column) -> Column:
    return F.filter(F.split(term, "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def term_hit(text: Column, term: Column) -> Column:
    """1 where the lower-case text holds the term, else the share of its longer tokens that it holds."""
    term = F.trim(F.lower(F.coalesce(term, F.lit(""))))
    parts = term_tokens(term)
    held = F.size(F.filter(parts, lambda t: F.contains(text, t)))
    share = F.when(F.size(parts) > 0, held / F.size(parts)).otherwise(0.0)
    return F.when(term == "", 0.0).when(F.contains(text, term), 1.0).otherwise(share)


def search_text(*columns) -> Column:
    """All fields in lower case, joined by spaces; null fields are empty, arrays joined by spaces."""
    parts = [F.concat_ws(" ", _col(c)) for c in columns]
    return F.lower(F.concat_ws(" ", *parts))


def evidence(text, pattern: str, before: int = 100, after: int = 180, limit: int = 500) -> Column:
    """The surroundings of the first match, white space squeezed; null without a match."""
    text = _col(text)
    at = F.regexp_instr(text, F.lit(pattern))
    found = F.length(F.regexp_extract(text, pattern, 0))
    start = F.greatest(at - before, F.lit(1))
    size = at + found + after - start
    return F.when(at > 0, F.substring(squeeze(F.substr(text, start, size)), 1, limit))


def blank(c) -> Column:
    return F.coalesce(F.btrim(_col(c), F.lit(" \t\n\r\f\u000b")), F.lit("")) == ""


def overlay(new, old) -> Column:
    """The new value unless it is null or an empty string."""
    return F.coalesce(F.nullif(_col(new), F.lit("")), _col(old))


def overlay_array(new, old) -> Column:
    return F.when(F.size(_col(new)) > 0, _col(new)).otherwise(_col(old))


def metadata_complete(title, abstract, summary) -> Column:
    return ~blank(title) & ~blank(overlay(abstract, summary))


def translation_complete(title, summary, script: str = CJK) -> Column:
    return has_script(title, script) & has_script(summary, script)


#: Markers of a failed upstream request.
REQUEST_FAILURES = ("429 Client Error", "Error code: 429", "insufficient_user_quota")
QUOTA_WORDS = ("余额不足", "额度不足")


def response_failed(c, markers=REQUEST_FAILURES) -> Column:
    c = _col(c)
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(c, F.lit(m))
    return blank(c) | F.coalesce(hit, F.lit(False))


def quota_failed(c) -> Column:
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    hit = F.contains(low, F.lit("insufficient_user_quota")) | (F.contains(low, F.lit("balance")) & F.contains(low, F.lit("insufficient")))
    for w in QUOTA_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def safe_citation_key(c) -> Column:
    """A citation key with everything but letters, digits, :, . and - as underscores."""
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9:._-]", "_")


def rechunk(values: Column, n: int = 3) -> Column:
    """An array cut into arrays of `n` at most."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / n) - 1, F.lit(0)).cast("int"))
    return F.when(F.size(values) > 0, F.transform(steps, lambda i: F.slice(values, i * n + 1, F.lit(n))))


# Names of main TeX files, and of files that only hold a body.
MAIN_NAMES = ("main.tex", "paper.tex", "root.tex", "manuscript.tex", "article.tex")
BODY_NAMES = ("paper_body.tex", "body.tex", "content.tex")


def main_document_score(path, content, stems) -> Column:
    """Rank of a candidate main TeX file: its name, and whether it includes another candidate.

    stems: array of the candidates' file names in lower case, without extension.
    """
    base = lambda x: F.regexp_extract(F.lower(F.replace(x, F.lit("\\"), F.lit("/"))), r"([^/]*)$", 1)
    name = base(_col(path))
    included = F.transform(F.regexp_extract_all(strip_comment(F.coalesce(_col(content), F.lit(""))), F.lit(r"\\(?:input|include)\s*\{([^{}]+)\}"), F.lit(1)), lambda x: F.regexp_replace(base(F.trim(x)), r"\.[^.]*$", ""))
    score = F.when(name.isin(*MAIN_NAMES), 100).otherwise(0) - F.when(name.isin(*BODY_NAMES), 100).otherwise(0)
    return score + F.when(F.arrays_overlap(included, _col(stems)), 20).otherwise(0)


def no_shell_escape(c) -> Column:
    """A TeX command line with shell escape switched off."""
    x = F.regexp_replace(_col(c), r"\s+--?(?:enable-write18|shell-escape|shell-restricted)\b", "")
    return F.regexp_replace(x, r"^(\s*\S*(?:xelatex|pdflatex|lualatex|latex)\b)(?!.*-no-shell-escape)", "$1 -no-shell-escape")
