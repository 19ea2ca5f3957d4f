"""The response gate: which translated slots are refused, and why."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CITATION
from .predicates import is_drawing, is_option_list, is_style_definition
from .prose import UNSAID, WORD, group, headed_names, name_catalog, own_prose, prose, prose_words, unsaid
from .source_data import fragment, is_source_block
from .text import CJK, _col, blank, brace_balance, letters, response_failed, script_chars, strip_comment, tokens

# Commands whose order must survive, and the echo of a task description.
CRITICAL = r"(?i)\\(section|subsection|subsubsection|paragraph|subparagraph|item|caption|footnote|begin|end)\b"
TASK_ECHO = r"(?is)\A(?=.*\bclassification\s*:\s*academic\s+translation\b)(?=.*\btask\s*:\s*english\s+to\s+chinese\b)(?=.*\blanguage\s*:\s*chinese\b)"
GLUE_WORDS = frozenset(
    "a an and are as at be been being but by each for from if in into is it its of on or our that the their then these this those to was we were when where which while with".split()
)


def _structural(c) -> Column:
    """A fragment as far as its structure goes: without prompt, code, addresses and comments."""
    return strip_comment(unsaid(fragment(c), UNSAID[:2]))


def command_signature(c) -> Column:
    """The critical commands of a text in order, lower case."""
    return F.transform(F.regexp_extract_all(_structural(c), F.lit(CRITICAL), F.lit(1)), lambda x: F.lower(x))


def citation_signature(c) -> Column:
    """The sorted citations of a text: command, the numbers of its options, keys. Words in options may be translated."""

    def one(x: Column) -> Column:
        numbers = F.regexp_extract_all(F.regexp_extract(x, r"^[^\[{]*((?:\[[^\]]*\])*)", 1), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
        keys = F.transform(F.split(F.regexp_extract(x, r"\{([^{}]*)\}$", 1), ","), lambda k: F.trim(k))
        return F.concat(F.lower(F.regexp_extract(x, r"^[^\[{]*", 0)), F.lit("["), F.array_join(numbers, ","), F.lit("]{"), F.array_join(keys, ","), F.lit("}"))

    return F.array_sort(F.transform(F.regexp_extract_all(_structural(c), F.lit(CITATION), F.lit(0)), one))


def invalid_reason(source, response) -> Column:
    """Empty for a structurally sound response, else the first reason against it."""
    source, response = F.coalesce(_col(source), F.lit("")), F.coalesce(_col(response), F.lit(""))
    return (
        F.when(response.rlike(TASK_ECHO), "translation_task_echo")
        .when(brace_balance(source) != brace_balance(response), "latex_brace_balance_mismatch")
        .when(command_signature(source) != command_signature(response), "critical_latex_structure_mismatch")
        .when(citation_signature(source) != citation_signature(response), "citation_structure_mismatch")
        .otherwise("")
    )


# A heading command without its argument, and the word that was meant.
_BARE_HEADING = r"\\(section|subsection|subsubsection|paragraph|subparagraph)\*?+(?![A-Za-z@])(?!\s*\{)"
_HEADING_WORDS = {"section": "章节", "subsection": "小节", "subsubsection": "小节", "paragraph": "段落", "subparagraph": "段落"}
_HEADED = r"(?s)^\s*\\(?:section|subsection|subsubsection|paragraph|subparagraph)\*?\s*(" + group(6) + r")\s*$"


def with_normal_response(pairs: DataFrame, source: str = "source", response: str = "response", name: str = "normal") -> DataFrame:
    """`pairs` with the response after one provable slip is taken back, else as it is.

    Slips: a last brace too many; then, where the source has no critical command, one bare heading command in place
    of the word, or a heading command around the whole. Taken back only if braces, commands and citations are those
    of the source afterwards. A starred heading with an argument is no bare one. Null counts as empty. Columns of the caller
    stay; `name` is replaced.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))

    def proven(c: str) -> Column:
        return (command_signature(c) == F.col("_commands")) & (citation_signature(c) == F.col("_cites"))

    out = pairs.withColumns({"_s": fragment(source), "_r": text(response)})
    out = out.withColumns({"_commands": command_signature("_s"), "_cites": citation_signature("_s"), "_braces": brace_balance("_s"), "_less": F.regexp_replace("_r", r"\}(\s*)$", "$1")})
    surplus = F.col("_r").rlike(r"\}\s*$") & (brace_balance("_r") == F.col("_braces") - 1) & (brace_balance("_less") == F.col("_braces")) & proven("_less")
    out = out.withColumn("_trimmed", F.when(surplus, F.col("_less")).otherwise(F.col("_r")))
    worded, inner = F.col("_trimmed"), F.regexp_extract("_trimmed", _HEADED, 1)
    for command, word in _HEADING_WORDS.items():
        worded = F.regexp_replace(worded, _BARE_HEADING.replace("|".join(_HEADING_WORDS), command), word)
    out = out.withColumns({"_worded": worded, "_inner": F.regexp_replace(inner, r"(?s)^\{(.*)\}$", "$1"), "_bare": F.regexp_count("_trimmed", F.lit(_BARE_HEADING)), "_headed": F.col("_trimmed").rlike(_HEADED)})
    normal = (
        F.when(blank("_s") | blank("_r"), F.col("_r"))
        .when(F.size("_commands") > 0, F.col("_trimmed"))
        .when((F.col("_bare") == 1) & proven("_worded"), F.col("_worded"))
        .when(F.col("_headed") & proven("_inner"), F.col("_inner"))
        .otherwise(F.col("_trimmed"))
    )
    return out.withColumn(name, normal).drop("_s", "_r", "_commands", "_cites", "_braces", "_less", "_trimmed", "_worded", "_inner", "_bare", "_headed")


# What may stand between the words of a clause.
_GAP = r"[\s,;:()\[\]{}~\\'\"-]*"
_RUN = rf"(?U){WORD}(?:{_GAP}{WORD})*"
_CLAUSE = "array<struct<text:string,words:int,letters:int>>"


def english_clauses(c, script: str = CJK) -> Column:
    """English clauses left within prose of another script, what is quoted left aside: runs of four words or more, twelve
    letters, with a glue word and a lower-case content word; only where six characters of the script stand too."""
    own = own_prose(c)

    def clause(run: Column) -> Column:
        words = F.regexp_extract_all(run, F.lit(WORD), F.lit(0))
        content = F.filter(words, lambda w: ~F.lower(w).isin(*sorted(GLUE_WORDS)))
        size = F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w))
        real = (F.size(words) >= 4) & (size >= 12) & (F.size(content) < F.size(words)) & F.exists(content, lambda w: w.rlike("^[a-z]"))
        return F.when(real, F.struct(F.substring(F.array_join(words, " "), 1, 220).alias("text"), F.size(words).alias("words"), size.alias("letters")))

    found = F.filter(F.transform(F.regexp_extract_all(own, F.lit(_RUN), F.lit(0)), clause), lambda x: x.isNotNull())
    return F.when((script_chars(own, script) >= 6) & ~is_drawing(c), found).otherwise(F.array().cast(_CLAUSE))


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table at a time: bit i of an integer says whether
    column i of the row equals the column before it."""
    places: dict[str, int] = {}
    for ch in set(a) & set(b):
        places[ch] = int("".join("1" if x == ch else "0" for x in reversed(a)), 2)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Twice the common length over both lengths; 0 where counts of characters show that it is under `least`."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total or 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return 0.0
    return 2 * common_length(a, b) / total


NEAR = 0.92


@F.pandas_udf(T.DoubleType())
def near_copy(a, b):
    """Similarity of two texts from NEAR on, else 0; null where one is null."""
    import pandas as pd

    return pd.Series([None if x is None or y is None else r if (r := similarity(x, y, NEAR)) >= NEAR else 0.0 for x, y in zip(a, b)], dtype="float64")


def copy_ratio(source, response) -> Column:
    """Similarity of two texts' words in lower case, 0 under NEAR."""
    said = lambda c: F.array_join(prose_words(F.coalesce(_col(c), F.lit(""))), " ")
    return near_copy(said(source), said(response))


def untranslated(source, response, script: str = CJK) -> Column:
    """Whether a prose slot came back without the target script (the part that needs no copy test)."""
    s, r = _col(source), _col(response)
    prose = (letters(s) >= 40) & (F.size(tokens(s)) >= 6) & (script_chars(s, script) < 8)
    return response_failed(r) | F.coalesce(prose & (letters(r) >= 24) & (script_chars(r, script) < 6), F.lit(False))


def with_verdict(pairs: DataFrame, source: str = "source", response: str = "response", script: str = CJK, name: str = "verdict") -> DataFrame:
    """`pairs` with why a slot counts as untranslated: failed, clause (English left within the script), copy (the source's
    words again, or nearly), script (prose came back without the script); empty for a translation, and for sources that
    need none: source data, drawings, options, lists of names.

    Prose is what prose() leaves of both. Null source or response: an empty one (an empty response has failed). The copy test runs
    for short prose only that the script doesn't settle. Columns of the caller stay; `name` is replaced.
    """
    s, r = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(response), F.lit(""))
    free = is_source_block(s) | is_drawing(s) | is_style_definition(s) | name_catalog(s) | headed_names(s, r, script)
    counted = pairs.withColumns({"_s": prose(s), "_r": prose(r), "_free": free, "_options": is_option_list(fragment(s))})
    counted = counted.withColumns({"_sw": prose_words(F.col("_s")), "_rw": prose_words(F.col("_r"))})
    foreign = (script_chars("_s", script) < 8) & (script_chars("_r", script) < 6)
    short = foreign & (letters("_s") >= 12) & (F.size("_sw") >= 3) & (letters("_r") >= 10)
    long = foreign & (letters("_s") >= 40) & (F.size("_sw") >= 6) & (letters("_r") >= 24)
    words = lambda c: F.when(short & ~long & ~F.col("_free"), F.array_join(c, " "))
    compared = counted.withColumns({"_a": words("_sw"), "_b": words("_rw")}).withColumn("_near", near_copy("_a", "_b"))
    exact = F.array_join("_sw", " ") == F.array_join("_rw", " ")
    verdict = (
        F.when(response_failed(r), "failed")
        .when(F.col("_free") | F.col("_options"), "")
        .when(F.size(english_clauses(r, script)) > 0, "clause")
        .when(short & exact | (F.coalesce("_near", F.lit(0.0)) >= NEAR), "copy")
        .when(long, "script")
        .otherwise("")
    )
    return compared.withColumn(name, verdict).drop("_s", "_r", "_free", "_options", "_sw", "_rw", "_a", "_b", "_near")


#: What a prompt is told after a structural rejection, and the reasons that are structural.
RETRY_REMINDER = (
    "\n\nOn this retry, preserve every LaTeX command and its arguments, including all citation, reference, label, and section commands. "
    "Translate prose only; do not omit, rename, reorder, or invent LaTeX commands or citation keys."
)
STRUCTURAL = ("critical_latex_structure_mismatch", "citation_structure_mismatch", "latex_brace_balance_mismatch")


def retry_prompt(prompt, reason, reminder: str = RETRY_REMINDER) -> Column:
    """The prompt with a reminder for structural reasons, added once."""
    prompt = F.coalesce(_col(prompt), F.lit(""))
    wanted = F.coalesce(_col(reason).isin(*STRUCTURAL), F.lit(False)) & ~F.contains(prompt, F.lit(reminder.strip()))
    return F.when(wanted, F.concat(prompt, F.lit(reminder))).otherwise(prompt)


def normal_completion(c) -> Column:
    """The text of a chat completion's first choice: its content, else the parts of the content that have text, a line
    each, else its reasoning, else the text of the choice; null without any, and for damaged JSON.

    A part is a string or an object whose text is a string or an object with a value.
    """
    choice = F.try_variant_get(F.try_parse_json(_col(c)), "$.choices[0]", "variant")
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    real = lambda x: F.when(~blank(x), x)
    parts = F.try_variant_get(choice, "$.message.content", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(said(p), said(at(p, "$.text")), said(at(p, "$.text.value"))))
    joined = F.array_join(F.filter(texts, lambda t: ~blank(t)), "\n")
    return F.coalesce(real(said(at(choice, "$.message.content"))), real(joined), real(said(at(choice, "$.message.reasoning_content"))), real(said(at(choice, "$.text"))))


def salvaged_json(c, fields: list[str]) -> Column:
    """Named string fields of a damaged JSON object: parsed where it parses after stray backslashes are doubled,
    else completed fields picked one by one."""
    body = F.regexp_extract(_col(c), r"(?s)\{.*\}?", 0)
    fixed = F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\")
    parsed = F.from_json(F.regexp_extract(fixed, r"(?s)\{.*\}", 0), ", ".join(f"`{f}` string" for f in fields))
    pick = lambda f: F.regexp_extract(fixed, rf'(?s)"{f}"\s*:\s*"((?:[^"\\]|\\.)*+)"', 1)
    return F.struct(*(F.coalesce(parsed[f], F.nullif(pick(f), F.lit(""))).alias(f) for f in fields))
