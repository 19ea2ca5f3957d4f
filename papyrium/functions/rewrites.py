"""Text repairs: each gives the repaired text and how many places changed, as a struct (text, n).

Repairs that a pattern can say are native expressions. Those that need names defined in the same text, or
a balance of groups, are plain Python functions over one text, lifted to columns by `lifted`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import ARTIFACTS
from .text import _col

CJK = "\u4e00-\u9fff"
FOLLOW = f"[{CJK}，。！？；：、（）《》“”]"


def replaced(c, pattern: str, by: str) -> Column:
    """All matches of a pattern replaced, and their number."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.struct(F.regexp_replace(c, pattern, by).alias("text"), F.regexp_count(c, F.lit(pattern)).alias("n"))


def chained(c, *steps: Callable[[Column], Column]) -> Column:
    """Repairs one after another, their counts summed."""
    text, n = F.coalesce(_col(c), F.lit("")), F.lit(0)
    for step in steps:
        done = step(text)
        text, n = done["text"], n + done["n"]
    return F.struct(text.alias("text"), n.alias("n"))


def collapse_spaced_cjk(c) -> Column:
    return replaced(c, rf"([{CJK}，。！？；：、]) +(?=[{CJK}，。！？；：、])", "$1")


def drop_cjk_escapes(c) -> Column:
    return replaced(c, rf"\\(?={FOLLOW})", "")


def name_bare_citations(c) -> Column:
    return replaced(c, rf"\\cite(?={FOLLOW})", "文献")


def space_declarations(c) -> Column:
    return replaced(c, rf"\\(xspace|em|bf|it|rm|sf|tt)(?={FOLLOW})", r"\\$1 ")


def plain_references(c) -> Column:
    return replaced(c, r"\\[cC]ref(?:\s*\[[^\]]*\])?(?=\s*\{)", r"\\ref")


def _needed(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds; what groups and classes hold is passed over."""
    runs, run, depth, pattern = [], "", 0, re.sub(r"^\(\?[a-z]+\)", "", pattern)
    for part in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", pattern, re.DOTALL):
        if part == "|" and not depth:
            return ""
        depth += (part == "(") - (part == ")")
        if depth or part[0] in ".^$|()[" or part[0] == "\\" and part[1].isalnum():
            runs, run = [*runs, run], ""
        elif part[0] in "?*+{":
            runs, run = [*runs, run[:-1]], ""
        else:
            run += part[-1]
    return max([*runs, run], key=len)


def strip_artifacts(c, patterns: tuple[str, ...] = ARTIFACTS) -> Column:
    """Deletes every match of every pattern, in order. A pattern is tried only on texts that hold its longest plain piece."""
    text = F.coalesce(_col(c), F.lit(""))
    if not patterns:
        return F.struct(text.alias("text"), F.lit(0).alias("n"))
    any_case = [p.startswith("(?i)") for p in patterns]

    def tried(i: int, p: str) -> Column:
        needed = _needed(p).lower() if any_case[i] else _needed(p)
        return F.struct(F.lit(p).alias("pattern"), F.lit(needed).alias("needed"), F.lit(any_case[i]).alias("any_case"), F.lit(any(any_case[i + 1 :])).alias("low_again"))

    def step(done: Column, p: Column) -> Column:
        n = done["n"] + F.regexp_count(done["text"], p["pattern"])
        new = F.array(F.regexp_replace(done["text"], p["pattern"], F.lit("")))  # an element, so that it is made once
        cut = F.transform(new, lambda t: F.struct(t.alias("text"), F.when(p["low_again"], F.lower(t)).otherwise(done["low"]).alias("low"), n.alias("n")))
        held = F.when(p["any_case"], F.contains(done["low"], p["needed"])).otherwise(F.contains(done["text"], p["needed"]))
        return F.when(held & F.rlike(done["text"], p["pattern"]), F.get(cut, F.lit(0))).otherwise(done)

    start = F.struct(text.alias("text"), F.lower(text).alias("low"), F.lit(0).alias("n"))
    return F.aggregate(F.array(*(tried(i, p) for i, p in enumerate(patterns))), start, step, lambda done: F.struct(done["text"].alias("text"), done["n"].alias("n")))


def comment_endinput(c) -> Column:
    """Whole-line \\endinput commands as comments."""
    return replaced(c, r"(?m)^([ \t]*)\\endinput[ \t]*$", r"$1% \\endinput")


def drop_repeated_ends(c) -> Column:
    """The second of two equal ends of an environment that stand side by side."""
    return replaced(c, r"(\\end\{([A-Za-z*]+)\})\s*\\end\{\2\}(?=\s*\\end\{document\})", "$1")


_DEFINED = re.compile(r"\\(?:newcommand|renewcommand|providecommand|def)\*?\s*\{?\\([A-Za-z]+)\}?(?:\[(\d)\])?")


def _macros(text: str) -> set[str]:
    return {m[1] for m in _DEFINED.finditer(text) if m[2] in (None, "0")}


_COMMAND = re.compile(r"\\([A-Za-z@]+)")


def _commands(text: str, by: Callable[[str, int], str | None]) -> tuple[str, int]:
    """Every whole command of the text, by name and the place after it, replaced where `by` gives something else.

    The one reading of commands that repairs of macros share: a command is its longest run of letters.
    """
    out, at, n = [], 0, 0
    for m in _COMMAND.finditer(text):
        new = by(m[1], m.end())
        if new is not None:
            out += (text[at : m.start()], new)
            at, n = m.end(), n + 1
    return "".join([*out, text[at:]]), n


def separate_macro_glue(text: str) -> tuple[str, int]:
    """Ends macros without arguments by {} where a character of the script follows; a stray backslash between goes."""
    own = _macros(text)
    inside = sorted(m.span() for m in _DEFINED.finditer(text))
    starts = [a for a, _ in inside]

    def defined_here(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at <= inside[k][1]

    glued = re.compile(rf"(\\?){FOLLOW}")
    drop: list[int] = []

    def by(name: str, end: int) -> str | None:
        m = glued.match(text, end) if name in own and not defined_here(end) else None
        if m is None:
            return None
        if m[1]:
            drop.append(end)
        return f"\\{name}{{}}"

    fixed, n = _commands(text, by)
    if drop:  # the same reading again, without those backslashes
        text = "".join(text[a:b] for a, b in zip([0, *(d + 1 for d in drop)], [*drop, len(text)]))
        return separate_macro_glue(text)[0], n
    return fixed, n


def undouble_macro_initials(text: str) -> tuple[str, int]:
    """\\nname becomes \\name where only \\name is defined."""
    own = _macros(text)
    return _commands(text, lambda name, _: f"\\{name[1:]}" if name[:1] == name[1:2] and name[1:] in own and name not in own else None)


def drop_unmatched_ends(text: str, environments: tuple[str, ...] | None = None) -> tuple[str, int]:
    """Ends of environments that are not open."""
    depth: dict[str, int] = {}
    out, at, n = [], 0, 0
    for m in re.finditer(r"\\(begin|end)\{([A-Za-z*]+)\}", text):
        kind, env = m[1], m[2]
        if environments and env not in environments:
            continue
        if kind == "begin":
            depth[env] = depth.get(env, 0) + 1
        elif depth.get(env, 0):
            depth[env] -= 1
        else:
            out.append(text[at : m.start()])
            at, n = m.end(), n + 1
    return "".join([*out, text[at:]]), n


def plain_dashes_in_keys(text: str) -> tuple[str, int]:
    """Long dashes within labels, references and citation keys become hyphens."""
    n = 0

    def one(m):
        nonlocal n
        fixed = re.sub("[\u2013\u2014]", "-", m[2])
        n += fixed != m[2]
        return m[1] + fixed + m[3]

    return re.sub(r"(\\(?:label|ref|eqref|cref|cite[a-z]*)\*?\{)([^{}]*)(\})", one, text), n


def split_long_citations(text: str, most: int = 3) -> tuple[str, int]:
    """Citation lists of more than `most` keys become several commands."""
    n = 0

    def one(m):
        nonlocal n
        keys = [k.strip() for k in m[2].split(",") if k.strip()]
        if len(keys) <= most:
            return m[0]
        n += 1
        return "".join(f"{m[1]}{{{','.join(keys[i : i + most])}}}" for i in range(0, len(keys), most))

    return re.sub(r"(\\cite[a-z]*\*?)\{([^{}]*)\}", one, text), n


def demote_caption_headings(text: str) -> tuple[str, int]:
    """Heading commands within captions become bold text."""
    n, out, at = 0, [], 0
    for m in re.finditer(r"\\caption\*?(?:\[[^\]]*\])?\{", text):
        if m.end() <= at:
            continue
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0) if text[i - 1] != "\\" else 0
            i += 1
        body, k = re.subn(r"\\(?:sub)*(?:section|paragraph)\*?(?=\s*\{)", r"\\textbf", text[m.end() : i])
        n += k
        out += [text[at : m.end()], body]
        at = i
    return "".join([*out, text[at:]]), n


def restore_blocks(text: str, source: str, environment: str) -> tuple[str, int]:
    """The k-th block of an environment is the k-th block of the source where they differ and both have it."""
    block = re.compile(rf"\\begin\{{{re.escape(environment)}\}}.*?\\end\{{{re.escape(environment)}\}}", re.DOTALL)
    own = block.findall(source)
    n, k = 0, -1

    def one(m):
        nonlocal n, k
        k += 1
        if k >= len(own) or own[k] == m[0]:
            return m[0]
        n += 1
        return own[k]

    return block.sub(one, text), n


def resolve_labels(text: str) -> tuple[str, int]:
    """Undefined references whose text begins exactly one label, or names one with / for :, get that label."""
    labels = set(re.findall(r"\\label\{([^{}]+)\}", text))
    n = 0

    def one(m):
        nonlocal n
        ref = m[2]
        if ref in labels:
            return m[0]
        near = {ref.replace("/", ":")} & labels or {x for x in labels if x.startswith(ref + "_")}
        if len(near) != 1:
            return m[0]
        n += 1
        return f"{m[1]}{{{near.pop()}}}"

    return re.sub(r"(\\(?:ref|eqref|autoref|pageref)\*?)\{([^{}]+)\}", one, text), n


def lifted(repair: Callable[..., tuple[str, int]]):
    """A repair of texts as a function of columns; null texts are empty."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    def over(*texts):
        import pandas as pd

        rows = [repair(*(x or "" for x in row)) for row in zip(*texts)]
        return pd.DataFrame({"text": [t for t, _ in rows], "n": [n for _, n in rows]})

    return over
