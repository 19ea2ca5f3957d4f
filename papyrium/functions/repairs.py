"""Repairs of TeX that look at every match of a pattern with what the same text, or its source, defines.

`rewritten` is the native form: the text is cut at the matches, each match is mapped as an array element, and
the pieces are joined again, in time linear in the text. Repairs that follow a balance of groups are plain
functions over one text, for `rewrites.lifted`; so is what looks up keys. Each gives (text, n): the repaired text and how many
places changed. Null texts are empty; a text without a match comes back as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrites import chained, lifted, replaced
from .text import _col

WIDE = "\u3400-\u4dbf\u4e00-\u9fff"

# Commands that take no text, environments kept word for word, delimiters, keywords, anchors.
LAYOUT = ("cleardoublepage", "clearpage", "noindent", "smallskip", "medskip", "bigskip", "newline", "newpage", "hfill", "vfill", "par")
SPACED = ("newline", "newpage", "clearpage", "noindent", "indent", "smallskip", "medskip", "bigskip")
VERBATIM = ("tcblisting", "lstlisting", "verbatim", "Verbatim", "minted")
DELIMITERS = "@~/;:+="
KEYWORDS = {"Input": "Input", "Output": "Output", "KwIn": "Input", "KwOut": "Output"}
MATH = r"\\(?:mathcal|mathbf|mathbb|mathrm|mathsf|mathscr|operatorname|Pi|pi|Delta|Theta|Omega)\b"
POINTS_AT = "(?:图像|图|表格|表|公式|式|第|附录)"
REFERS = r"\s*~?\\(?:ref|eqref|autoref|cref|Cref)\{"
CITE = r"\\(citep|citet|citealt|citeauthor|citeyearpar|citealp|citeyear|nocite|cite)((?:\[[^\]]*\]){0,2})\{([^{}]+)\}"
NO_ENTRY = "缺失引用"

_DEFINES = r"\\(?:(?:newcommand|renewcommand|providecommand|DeclareRobustCommand)\*?\s*\{?|(?:def|gdef|edef|xdef|let)\s*)\\([A-Za-z@]+)"
_MATRIX = r"(?ms)\\matrix\b.*?^[ \t]*\};[ \t]*$"


def _text(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _all(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(group))


def _part(c, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _keys(c) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda k: F.trim(k)), lambda k: k != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, also where lambdas inside ask for it at every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def defined_commands(*texts) -> Column:
    """Names of the commands that some texts define."""
    return F.array_distinct(F.concat(*(_all(t, _DEFINES) for t in texts)))


def rewritten(c, pattern, by: Callable[[Column], Column], places: Callable[[Column], Column] | None = None) -> Column:
    """Each match of a pattern replaced by what `by` makes of it; null leaves it. `places` says how many
    places a replaced match counts for, one otherwise."""
    text = _text(c)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    changed = F.transform(found, lambda m: F.struct(by(m).alias("new"), m.alias("old")))
    pieces = F.zip_with(F.split(text, pattern, -1), changed, lambda gap, m: F.concat(gap, F.coalesce(m["new"], m["old"], F.lit(""))))
    hits = F.filter(changed, lambda m: m["new"].isNotNull())
    n = F.size(hits) if places is None else F.aggregate(hits, F.lit(0), lambda a, m: a + places(m["old"]))
    return F.struct(F.array_join(pieces, "").alias("text"), n.alias("n"))


def space_layout_words(c, definitions=None) -> Column:
    """A space between a layout command and a capitalised or CJK word glued to it, unless the whole is a command that the
    text or `definitions` defines. Comments and lines of verbatim environments stay."""
    names = "|".join(LAYOUT)
    keep = rf"(?ms)^[^\n]*\\begin\{{({'|'.join(VERBATIM)})\}}.*?(?:\\end\{{\1\}}[^\n]*|\z)|(?<!\\)(?:\\\\)*%[^\n]*"
    glued = rf"\\(?:{names})(?:[A-Z][a-z]{{1,40}}(?=\z|[\\\s()\[\],.;:!?，。；：！？{WIDE}])|(?=[{WIDE}]))"
    own = defined_commands(c, *(() if definitions is None else (definitions,)))
    whole = rf"\A(\\(?:{names}))([A-Z][a-z]+)?\z"
    return _bound(own, lambda own: rewritten(c, f"{keep}|{glued}", lambda m: F.when(m.rlike(whole) & ~F.array_contains(own, F.substr(m, F.lit(2))), F.regexp_replace(m, whole, "$1 $2"))))


def space_layout_commands(c) -> Column:
    return replaced(c, rf"\\({'|'.join(SPACED)})(?=[\u4e00-\u9fff])", r"\\$1 ")


def drop_empty_groups(c, names: tuple[str, ...]) -> Column:
    """`{}` behind given commands without arguments goes where CJK text follows."""
    if not names:
        return F.struct(_text(c).alias("text"), F.lit(0).alias("n"))
    longest = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
    return replaced(c, rf"\\({longest})\{{\}}(?=\s*[{WIDE}，。！？；：、（）《》“”‘’])", r"\\$1")


def space_algorithm_commands(c) -> Column:
    """Steps of an algorithm glued to CJK text: comments get braces, the others a space."""
    return chained(
        c,
        lambda x: replaced(x, r"(?m)^(\s*)\\Comment([\u4e00-\u9fff][^{}\n]*?)[ \t]*$", r"$1\\Comment{$2}"),
        lambda x: replaced(x, r"\\(State|Require|Ensure|Return)(?=[\u4e00-\u9fff])", r"\\$1 "),
    )


def embolden_text_words(c) -> Column:
    r"""\textWord without a definition, in front of punctuation or space, is the bold word."""
    own = _all(c, r"\\(?:newcommand|renewcommand|providecommand)\s*\{\\([A-Za-z@]+)\}")
    word = r"\\text[A-Z][A-Za-z]{1,40}(?=[:：,，.;；!?！？\s])"
    return _bound(own, lambda own: rewritten(c, word, lambda m: F.when(~F.array_contains(own, F.substr(m, F.lit(2))), F.concat(F.lit("\\textbf{"), F.substr(m, F.lit(6)), F.lit("}")))))


def restore_math_alias(c, short: str = "I", full: str = "Imat") -> Column:
    """The short name of a command becomes the full one where only that is defined."""
    own = F.array_distinct(_all(c, r"\\(?:(?:provide|new|renew)command\*?\s*\{?|def)\\([A-Za-z]+)"))
    fixed = replaced(c, rf"\\{short}(?![A-Za-z@])", rf"\\{full}")
    same = F.struct(_text(c).alias("text"), F.lit(0).alias("n"))
    return F.when(F.array_contains(own, full) & ~F.array_contains(own, short), fixed).otherwise(same)


def split_label_lists(c) -> Column:
    """A reference to several labels becomes one for each, if the text defines them all and not the list as one."""
    pattern = r"\\(ref|eqref|autoref)\{([^{}\n]*,[^{}\n]*)\}"
    labels = F.array_distinct(F.transform(_all(c, r"\\label\{([^{}\n]+)\}"), lambda x: F.trim(x)))

    def by(m, labels):
        names = F.transform(F.split(_part(m, pattern, 2), ","), lambda x: F.trim(x))
        known = F.forall(names, lambda x: (x != "") & F.array_contains(labels, x)) & ~F.array_contains(labels, F.trim(_part(m, pattern, 2)))
        return F.when(known, F.array_join(F.transform(names, lambda x: F.concat(F.lit("\\"), _part(m, pattern, 1), F.lit("{"), x, F.lit("}"))), ", "))

    return _bound(labels, lambda labels: rewritten(c, pattern, lambda m: by(m, labels)))


def matrix_breaks_as_spaces(c) -> Column:
    """Line breaks between words inside matrices of a drawing become spaces."""
    inner = r"(?<=[A-Za-z0-9)])\\\\(?=[A-Za-z0-9(])"
    return rewritten(c, _MATRIX, lambda m: F.when(m.rlike(inner), F.regexp_replace(m, inner, " ")), lambda m: F.regexp_count(m, F.lit(inner)))


def omit_matrix_legends(c, note: str = "% omitted: legend drawn inside a matrix of nodes") -> Column:
    """Matrices of nodes that draw by themselves and stand as a legend, or around the picture's box, become a comment."""
    return rewritten(c, _MATRIX, lambda m: F.when(m.contains("matrix of nodes") & m.rlike("(?i)current bounding box|legend") & m.rlike(r"\\node|\\draw"), F.lit(note)))


def close_box_groups(c) -> Column:
    r"""Blocks of environments that the text declares as boxes get the \endgroup they lack."""
    names = F.array_distinct(_all(c, r"\\(?:newtcolorbox|DeclareTColorBox)\s*\{([A-Za-z][A-Za-z0-9*_-]*)\}"))
    either = F.array_join(F.transform(names, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|")
    pattern = F.when(F.size(names) > 0, F.concat(F.lit(r"(?s)\\begin\{("), either, F.lit(r")\}.*?\\end\{\1\}"))).otherwise(r"(?!)")

    def lacking(m):
        return F.regexp_count(m, F.lit(r"\\begingroup")) - F.regexp_count(m, F.lit(r"\\endgroup"))

    def by(m):
        tail = _part(m, r"(\\end\{[^{}]*\})\z", 1)
        head = F.substr(m, F.lit(1), F.length(m) - F.length(tail))
        return F.when(lacking(m) > 0, F.concat(head, F.repeat(F.lit("\\endgroup\n"), lacking(m)), tail))

    return rewritten(c, pattern, by, lacking)


def declare_keywords(c) -> Column:
    """Keywords of algorithms that are used and not declared get a declaration before the first algorithm, or the body."""
    text = _text(c)
    missing = F.filter(
        F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in KEYWORDS.items())),
        lambda w: text.contains(F.concat(F.lit("\\"), w["k"], F.lit("{"))) & ~text.contains(F.concat(F.lit("\\SetKwInOut{"), w["k"], F.lit("}"))),
    )
    lines = F.transform(missing, lambda w: F.concat(F.lit("\\SetKwInOut{"), w["k"], F.lit("}{"), w["v"], F.lit("}\n")))
    spots = [F.instr(text, s) for s in ("\\begin{algorithm", "\\begin{document}")]
    at = F.when(spots[0] > 0, spots[0]).otherwise(spots[1])
    due = (F.size(missing) > 0) & text.contains("\\SetKwInOut") & (at > 0)
    new = F.concat(F.substr(text, F.lit(1), at - 1), F.array_join(lines, ""), F.substr(text, at))
    return F.struct(F.when(due, new).otherwise(text).alias("text"), F.when(due, F.size(missing)).otherwise(0).alias("n"))


def close_bold_heads(c) -> Column:
    """Bold text that runs into a reference is closed after its punctuation."""
    return replaced(c, rf"(\\textbf\{{[^{{}}\n]{{1,100}}?[。！？；：:])(?=如?{POINTS_AT}{REFERS})", r"$1}")


def close_inline_math(c) -> Column:
    r"""Lines with \) and no \( have $ for it, if that makes a pair around mathematics."""
    dollars = lambda m: F.replace(m, F.lit("\\)"), F.lit("$"))
    return rewritten(c, r"(?m)^[^\n]*\\\)[^\n]*$", lambda m: F.when(~m.contains("\\(") & (F.regexp_count(dollars(m), F.lit(r"\$")) >= 2) & m.rlike(MATH), dollars(m)))


def restore_links(c, source) -> Column:
    """Links cut off by a line end are the source's first link whose address they begin, or go."""
    link = r"\\href\{([^{}]+)\}\{([^{}]*)\}"
    links = F.arrays_zip(_all(source, link, 1).alias("url"), _all(source, link, 2).alias("shown"))

    def by(m, links):
        cut = F.trim(_part(m, r"\{([^}\n]+)\n", 1))
        alike = F.filter(links, lambda x: F.startswith(x["url"], cut) | F.startswith(cut, F.substr(x["url"], F.lit(1), F.greatest(F.lit(8), F.length(cut)))))
        first = F.get(alike, F.lit(0))
        return F.coalesce(F.concat(F.lit("\\href{"), first["url"], F.lit("}{"), first["shown"], F.lit("}\n")), F.lit(""))

    return _bound(links, lambda links: rewritten(c, r"\\href\{[^}\n]+\n", lambda m: by(m, links)))


def compact_aux(c) -> Column:
    """Rows of an auxiliary file: those written to lists go, labels keep number and page only, malformed labels go."""
    label = r"\A[ \t]*\\newlabel\{([^{}]+)\}\{\{([^{}]*)\}\{([^{}]*)\}"

    def by(m):
        short = F.concat(F.lit("\\newlabel{"), _part(m, label, 1), F.lit("}{{"), _part(m, label, 2), F.lit("}{"), _part(m, label, 3), F.lit("}}\n"))
        new = F.when(m.rlike(label), short).otherwise("")
        return F.when(new != m, new)

    return rewritten(c, r"(?m)^[ \t]*\\(?:@writefile|newlabel)[^\n]*(?:\n|\z)", by)


def icon_commands(c) -> Column:
    """Distinct icon commands without arguments, sorted."""
    return F.array_sort(F.array_except(_all(c, r"\\(fa[A-Z][A-Za-z]+)\b"), F.array(F.lit("faIcon"))))


def include_target(c) -> Column:
    return F.regexp_replace(_text(c), r"\A\s+|\s+\z", "")


def cited_keys(c) -> Column:
    """Distinct citation keys in order of their first place."""
    return F.array_distinct(F.flatten(F.transform(_all(c, CITE, 3), _keys)))


def citation_aux(c, source=None) -> Column:
    """The auxiliary rows from which a bibliography can be made: keys, style and data, the last ones from the source where
    the text has none. Null without keys or data."""
    both = [_text(c)] + ([] if source is None else [_text(source)])

    def last(pattern):
        return F.coalesce(*(F.try_element_at(_all(t, pattern), F.lit(-1)) for t in both))

    data = last(r"\\bibliography\{([^{}]+)\}")
    style = F.coalesce(last(r"\\bibliographystyle\{([^{}]+)\}"), F.lit("plainnat"))
    keys = F.array_join(F.transform(cited_keys(c), lambda k: F.concat(F.lit("\\citation{"), k, F.lit("}\n"))), "")
    return F.when(keys != "", F.concat(F.lit("\\relax\n"), keys, F.lit("\\bibstyle{"), style, F.lit("}\n\\bibdata{"), data, F.lit("}\n")))


_CITED, _BIBITEM = re.compile(CITE), re.compile(r"\\bibitem(?:\[[^\]]*\])?\{([^{}]+)\}")


def _missing_marked(text: str, entries: str) -> tuple[str, int]:
    known, missing = set(_BIBITEM.findall(entries)), set()

    def one(m):
        name, options, listed = m.groups()
        keys = [k for k in (k.strip(" ") for k in listed.split(",")) if k]
        lacks = [k for k in keys if k not in known]
        if not lacks:
            return m[0]
        missing.update(lacks)
        has = ",".join(k for k in keys if k in known)
        if name == "nocite":
            return f"\\nocite{{{has}}}" if has else ""
        rest = f"\\{name}{options}{{{has}}}" if has else ""
        return f"{rest}\\textsuperscript{{[{NO_ENTRY}:{','.join(lacks)}]}}"

    return (_CITED.sub(one, text), len(missing)) if known else (text, 0)


def mark_missing_citations(c, entries) -> Column:
    """Cited keys without an entry in a bibliography become a mark; n counts such keys. Without any entry nothing changes.

    Keys are looked up in a set of each text's entries: an array expression would walk all entries for every key.
    """
    return lifted(_missing_marked)(_col(c), _col(entries))


# Over one text.


def without_comments(text: str) -> str:
    """The text with comments as blanks, so that every place keeps its offset."""
    return re.sub(r"(\\.)|%[^\n]*", lambda m: m[1] or " " * len(m[0]), text)


def find_token(text: str, token: str) -> int:
    """Where a token first stands outside comments, or -1."""
    return without_comments(text or "").find(token)


def top_level_line(text: str, place: int) -> int:
    """The start of the last line up to a place that no group or option is open at."""
    open_, start = {"{": 0, "[": 0}, 0
    for m in re.finditer(r"\\.|[\[\]{}\n]", without_comments(text)[:place]):
        if m[0] == "\n":
            start = start if any(open_.values()) else m.end()
        elif m[0] in open_:
            open_[m[0]] += 1
        elif m[0] in "]}":
            kind = "[" if m[0] == "]" else "{"
            open_[kind] = max(open_[kind] - 1, 0)
    return start


def insert_in_preamble(text: str, snippet: str, commands: Iterable[str] = ()) -> tuple[str, int]:
    """A snippet on top-level lines before the first use of some commands in the preamble, else before the body, else at
    the end. Once it is there nothing changes."""
    if not snippet.strip() or snippet.strip() in text:
        return text, 0
    body = find_token(text, "\\begin{document}")
    uses = [at for at in (find_token(text, "\\" + x.lstrip("\\")) for x in commands) if at >= 0 and (body < 0 or at < body)]
    first = min(uses, default=body)
    if first < 0:
        return f"{text}{'' if text.endswith(chr(10)) else chr(10)}{snippet}\n", 1
    at = top_level_line(text, first)
    return f"{text[:at]}{snippet}\n{text[at:]}", 1


def _options(text: str, environment: str) -> list[tuple[int, int]]:
    """Spans of the bracketed options that open an environment."""
    out = []
    for opening in re.finditer(rf"\\begin\{{{re.escape(environment)}\}}\s*(?=\[)", text):
        depth = 0
        for m in re.compile(r"\\.|[\[\]]", re.DOTALL).finditer(text, opening.end()):
            depth += {"[": 1, "]": -1}.get(m[0], 0)
            if depth == 0 and m[0] == "]":
                out.append((opening.end(), m.end()))
                break
    return out


def restore_options(text: str, source: str, environment: str) -> tuple[str, int]:
    """The k-th options of an environment are the k-th of the source."""
    out, at, n = [], 0, 0
    for (a, b), (c, d) in zip(_options(text, environment), _options(source, environment)):
        out += [text[at:a], source[c:d]]
        n += text[a:b] != source[c:d]
        at = b
    return "".join([*out, text[at:]]), n


_VERB = re.compile(r"\\verb\*?(?![\s\\]|[^\W_])(.)")
_CODE = re.compile(r"\\[?.!$]|\br[\"']|\(\?|[\[\]^*+]")


def redelimit_verbs(text: str) -> tuple[str, int]:
    """Inline code that holds its own delimiter gets one that it doesn't hold."""
    out, at, n = [], 0, 0
    m = _VERB.search(text)
    while m:
        mark, a = m[1], m.end()
        line = text.find("\n", a)
        line = len(text) if line < 0 else line
        first, last = text.find(mark, a, line), text.rfind(mark, a, line)
        new = None
        if first < last:
            held = text[a:last]
            if "\\verb" not in held and _CODE.search(held):
                new = next((x for x in DELIMITERS if x != mark and x not in held), None)
        if new:
            out += [text[at : a - 1], new, held, new]
            at, n = last + 1, n + 1
        m = _VERB.search(text, last + 1 if new else max(a, first + 1))
    return "".join([*out, text[at:]]), n


_POINTS = re.compile(rf"{POINTS_AT}(?:{REFERS}|\b|[\u4e00-\u9fff])")


def drop_stray_braces(text: str) -> tuple[str, int]:
    """A closing brace between a sentence's end and a figure, table or formula goes where its line has none open."""
    out, at, n, balance = [], 0, 0, 0
    for m in re.finditer(r"\\.|[{}\n]", text):
        a = m.start()
        if m[0] == "\n":
            balance = 0
        elif m[0] == "{":
            balance += 1
        elif m[0] == "}":
            if balance <= 0 and a and text[a - 1] in "。！？；，、" and _POINTS.match(text, a + 1):
                out.append(text[at:a])
                at, n = a + 1, n + 1
            balance -= 1
    return "".join([*out, text[at:]]), n


_ENTRY = re.compile(r"(@[A-Za-z]+\s*\{\s*)([^,\s{}]+)(?=\s*,)")


def safe_key_names(bibliography: str) -> dict[str, str]:
    """New names for the keys of a bibliography with other characters than letters, digits and _ : . / -, by
    sorted key; a name that is taken is numbered from 2 on."""
    keys = sorted({m[2] for m in _ENTRY.finditer(bibliography)})
    sound = re.compile(r"[A-Za-z0-9_:./-]+")
    taken, names = {k for k in keys if sound.fullmatch(k)}, {}
    for key in keys:
        if key in taken:
            continue
        plain = re.sub(r"[^\w:./-]", "_", key.replace("+", "p").replace("#", "num"))
        plain = re.sub("_+", "_", plain.strip("._-:/")) or "citation_key"
        name, k = plain, 1
        while name in taken:
            k += 1
            name = f"{plain}_{k}"
        taken.add(name)
        names[key] = name
    return names


def safe_bibliography(bibliography: str) -> tuple[str, int]:
    names = safe_key_names(bibliography)
    return _ENTRY.sub(lambda m: m[1] + names.get(m[2], m[2]), bibliography), len(names)


def safe_citations(text: str, bibliography: str) -> tuple[str, int]:
    """Citations by the names of `safe_bibliography`; n counts the renamed keys of the bibliography."""
    names = safe_key_names(bibliography)
    if not names:
        return text, 0
    renamed = lambda keys: ",".join(names.get(k, k) for k in map(str.strip, keys.split(",")) if k)
    return re.sub(CITE, lambda m: f"\\{m[1]}{m[2]}{{{renamed(m[3])}}}", text), len(names)
