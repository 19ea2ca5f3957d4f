"""Source data inside papers: prompts, schemas, transcripts and examples that are printed, not said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# What a prompt printed in a paper looks like.
PROMPT = r"(?s)\A.*?Answer me only with the translated text:(?:\n\n|\r\n\r\n)"
BLOCK_START = (
    r"(?is)(?:\bprompt\s+(?:upsampler|engineer)\b(?=.*\b(?:json|xml|template)\b)"
    r"|\b(?:write|return|output)\b(?=.*<final_prompt>)(?=.*\b(?:json|template)\b)"
    r"|\b(?:all\s+top-level\s+keys|output_json_template|user\s+visual\s+request)\b"
    r"|\bstructured\s+json\b(?=.*\b(?:template|schema|every\s+top-level)\b))"
)
BLOCK_END = r"(?i)(?:\\end\{(?:Verbatim|verbatim|lstlisting|minted|tcblisting)\}|\\(?:section|subsection|subsubsection)\*?\{)"
TAG = r"(?i)</?([a-z][a-z0-9_-]{2,})\b[^>]*>"
TAG_PAIR = r"(?is)<([a-z][a-z0-9_-]{2,})\b[^>]*>.*?</\1>"
JSON_KEY = r'"[A-Za-z][A-Za-z0-9_-]{1,}"\s*:'
PLACEHOLDER = r"(?i)<\s*[a-z][a-z0-9_-]*\s*>\s*\{(?:\{?\s*[A-Za-z_][A-Za-z0-9_]*\s*\}?)?\s*\}\s*</"
SCHEMA_WORDS = r"(?i)\b(?:exact\s+template|output_json_template|top-level\s+keys|json\s+(?:object|schema|template)|fenced\s+json)\b"
OUTPUT_ORDER = (
    r"(?i)^\s*(?:\\item(?:\[[^\]]*\])?\s*)?(?:return|output|respond\s+with)\b(?=.*\b(?:only|corrected)\b)(?=.*\b(?:code|json|xml)\b)"
    r"(?=.*(?:\\[A-Za-z@]*fence\{|fenced\s+(?:code|json)|code\s+block))"
)
FORMAT_ORDER = (
    r"(?i)^\s*(?:\\item(?:\[[^\]]*\])?\s*)?(?:then\s+provide\b(?=.*\b(?:reasoning|assessment)\b)(?=.*\b(?:exactly|block|lines?)\b)"
    r"|do\s+not\s+output\b(?=.*\boutside\b)(?=.*\b(?:analysis|block|lines?|tags?)\b)|you\s+must\s+output\b(?=.*\bexact\s+format\b)"
    r"|please\s+reason\s+step\s+by\s+step\b(?=.*\bfinal\s+answer\b)(?=.*(?:boxed|\\texttt)))"
)
# What makes one box of an environment source data, by its opening line or by a field inside.
BOX_TITLE = (
    r"(?i)(?:\b(?:system|developer|user|judge|agent|translation)[\s_-]*prompt\b|\bprompt[\s_-]*(?:template|example|block)?\b"
    r"|\b(?:execution|tool|agent|failure|success)[\s_-]*trace\b|\b(?:trajectory|transcript|source[\s_-]*data|benchmark[\s_-]*example)\b"
    r"|\b(?:user[\s_-]*query|demonstration[\s_-]*example)\b)"
)
BOX_CASE = r"(?i)(?:\bcasebox\s*=|success(?:bg|frame)?|fail(?:ure)?(?:bg|frame)?|成功案例|失败案例)"
BOX_STYLE = r"(?i)(?:^|[\[,{\s])(?:system|developer|user|judge|agent|prompt|instruction|template)[_-]?box\b"
BOX_FIELD = (
    r"(?i)^\s*\\(?:textbf|textit|emph)\s*\{(?:question|answer|response|correct\s+answer|user\s+query|task|role|instruction|input|output(?:\s+format)?|classification|language)\s*:?\s*\}"
)
FIELD_ENVIRONMENTS = ("tcolorbox", "custombox", "casebox", "examplebox")


def fragment(c) -> Column:
    """What stands after the first prompt marker in a request; the whole text without one."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), PROMPT, "")


def is_order(c) -> Column:
    """A line that tells a model how to answer."""
    return F.coalesce(_col(c).rlike(OUTPUT_ORDER) | _col(c).rlike(FORMAT_ORDER), F.lit(False))


def is_source_block(c) -> Column:
    """A whole prompt or schema: an opening phrase together with tags, keys or a template, never one of them alone."""
    c = fragment(c)
    tags = F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(TAG_PAIR), F.lit(1)), lambda t: F.lower(t))))
    schema = c.rlike(SCHEMA_WORDS)
    shown = (tags >= 2) & (c.rlike(PLACEHOLDER) | schema)
    final = F.contains(F.lower(c), F.lit("<final_prompt>")) & schema
    keyed = (F.regexp_count(c, F.lit(JSON_KEY)) >= 4) & schema & (tags >= 1)
    return is_order(c) | (c.rlike(BLOCK_START) & (shown | final | keyed))


def starts_block(line) -> Column:
    """Whether a line begins a block of source data that goes on below it."""
    line = F.coalesce(_col(line), F.lit(""))
    named = F.contains(F.lower(line), F.lit("json")) | F.contains(F.lower(line), F.lit("template"))
    return line.rlike(BLOCK_START) & (line.rlike(TAG) | named) | is_source_block(line)


def ends_block(line) -> Column:
    return F.coalesce(_col(line).rlike(BLOCK_END), F.lit(False))


def marks_box(environment, line) -> Column:
    """Whether the opening line of an environment says that this box of it is source data."""
    e, line = _col(environment), F.coalesce(_col(line), F.lit(""))
    after = F.call_function("substring_index", line, F.concat(F.lit("\\begin{"), e, F.lit("}")), F.lit(-1))
    here = F.contains(line, F.concat(F.lit("\\begin{"), e, F.lit("}")))
    return here & (
        F.when(e == "examplebox", F.trim(after) != "")
        .when(e == "casebox", line.rlike(BOX_CASE))
        .when(e == "tcolorbox", line.rlike(BOX_CASE) | line.rlike(BOX_STYLE) | line.rlike(BOX_TITLE))
        .when(e.isin("custombox", "mdframed"), line.rlike(BOX_TITLE))
        .otherwise(False)
    )


def names_field(line) -> Column:
    """A line that begins with a field of an example: a question, an answer, a task."""
    return F.coalesce(_col(line).rlike(BOX_FIELD), F.lit(False))
