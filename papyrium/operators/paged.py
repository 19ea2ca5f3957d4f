"""Quality of paged texts: every page gets a class, and the classes a document's verdict.

State (within references, within an appendix) goes from page to page, so pages of a text are read in order by
one Python function; texts are independent rows. Totals and verdicts are DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches
from .quality import is_untranslated_paged

# What marks a kind of page.
SCRIPT = "[一-鿿]"
WORD = r"\b[A-Za-z][A-Za-z-]{2,}\b"
REFUSAL = r"抱歉[，,]?\s*我(?:目前)?(?:无法|不能)[^。！？\n]{0,100}(?:查看|访问|翻译|处理|完成|提供)"
REFERENCES = r"(?im)(?:^|[ \t]{4,})[ \t]*(?:参考文献|references|bibliography)(?=$|[ \t]{3,})"
APPENDIX = r"(?im)^\s*(?:附录(?:\s*[A-Z0-9])?|appendix(?:\s+[A-Z0-9])?|supplementary\s+(?:material|information))\b"
ENTRY = r"(?m)^\s*\[\d{1,4}\](?:\s+|$)"
CONTENTS = r"(?im)^\s*(?:table\s+of\s+)?contents\s*$"
DOTS = r"(?:\.\s*){5,}"
TABLE = r"(?im)^\s*(?:table|表)\s*\d+"
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)*(?:%|×)?"
PROOF = r"(?im)(?:^\s*(?:proof|proposition|theorem|lemma|definition|sufficient\s+condition)\b|\bthis\s+(?:completes|concludes)\s+the\s+proof\b)"
SECTION = r"(?im)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:conclusions?|discussion|methods?|methodology|results?)\s*$"
NARRATIVE = r"(?i)\b(?:in\s+(?:this|the)\s+(?:paper|work|study)|in\s+conclusion|we\s+(?:present|propose|introduce|find|demonstrate|show|aim)|despite\s+(?:its|the|these))\b"
TURN = r"(?im)^\s*(?:system|developer|user|assistant|task|prompt|question|answer|response)\s*(?:prompt|message)?\s*:|<(?:user|assistant|system|think)>"
FIELD = r'"[A-Za-z][A-Za-z0-9_-]*"\s*:'
MIN_TEXT, MIN_WORDS, MIN_SCRIPT = 300, 30, 100
DOMINANT_LETTERS, DOMINANT_WORDS, DOMINANT_PCT = 700, 100, 20.0
LINE_LETTERS, LINE_WORDS, LINE_PCT = 15, 3, 10.0

#: What a text in lower case holds, one at least, where a pattern can match: it is looked for first, by plain search.
NEEDED = {
    "references": ("参考文献", "references", "bibliography"),
    "appendix": ("附录", "appendix", "supplementary"),
    "contents": ("contents",),
    "table": ("table", "表"),
    "proof": ("proof", "proposition", "theorem", "lemma", "definition", "sufficient"),
    "section": ("conclusion", "discussion", "method", "result"),
    "turn": ("system", "developer", "user", "assistant", "task", "prompt", "question", "answer", "response", "<think>"),
}
_OTHER_CASE = "\u0130\u0131\u017f"  # patterns take them for i and s, str.lower() doesn't
_LETTERS = bytes([*range(65, 91), *range(97, 123)])

CLASSES = ("refusal", "reference", "structural", "short", "source", "analyzable")


class _Reader:
    """Reads the pages of one text in order."""

    def __init__(self, script: str):
        self.script, self.word = re.compile(script), re.compile(WORD)
        for name in ("REFUSAL", "REFERENCES", "APPENDIX", "ENTRY", "CONTENTS", "DOTS", "TABLE", "NUMBER", "PROOF", "SECTION", "NARRATIVE", "TURN", "FIELD"):
            setattr(self, name.lower(), re.compile(globals()[name]))

    def matches(self, name: str, text: str, low: str) -> list[re.Match]:
        """All matches of a pattern; `low` is the text in lower case."""
        if any(x in low for x in NEEDED[name]) or any(x in text for x in _OTHER_CASE):
            return list(getattr(self, name).finditer(text))
        return []

    def counts(self, text: str) -> tuple[int, int, list[tuple[str, int, int]]]:
        """Letters and words, which end with their line; and each line with its own."""
        lines = []
        for line in text.splitlines():
            said = line.encode("utf-8", "surrogatepass")
            a = len(said) - len(said.translate(None, _LETTERS))
            lines.append((line, a, len(self.word.findall(line)) if a > 2 else 0))
        return sum(a for _, a, _ in lines), sum(w for _, _, w in lines), lines

    def strongest_lines(self, counted: list[tuple[str, int, int]]) -> tuple[int, int, str]:
        best, run = (0, 0, []), []
        for line, a, w in [*counted, ("", 0, 0)]:
            if a >= LINE_LETTERS and w >= LINE_WORDS and 100 * (s := len(self.script.findall(line))) / max(1, s + a) < LINE_PCT:
                run.append((line, w))
            elif run:
                now = (len(run), sum(x for _, x in run))
                if now > best[:2]:
                    best = (*now, run)
                run = []
        lines, said, run = best
        return lines, said, " ".join(" ".join(t.split()) for t, _ in run)[:360]

    def pages(self, text: str):
        """position, class, script, letters, words, dominant, partial of each page."""
        cut = text.split("\f")
        if len(cut) > 1 and not cut[-1].strip():
            cut.pop()
        in_references = in_appendix = False
        for pos, page in enumerate(cut, 1):
            refused = bool(self.refusal.search(page))
            low = page.lower()
            marks = sorted([(m.start(), "r") for m in self.matches("references", page, low)] + [(m.start(), "a") for m in self.matches("appendix", page, low)])
            kept, at, dropped = [], 0, in_references
            for where, kind in marks:
                if not in_references:
                    kept.append(page[at:where])
                in_references, in_appendix, at = kind == "r", in_appendix or kind == "a", where
                dropped = dropped or kind == "r"
            if not in_references:
                kept.append(page[at:])
            body = "".join(kept)
            low = body.lower() if marks or not body else low
            s = len(self.script.findall(body))
            a, w, counted = self.counts(body)
            pct = 100 * s / max(1, s + a)
            dominant = partial = False
            if refused:
                kind = "refusal"
            elif dropped and not body.strip() or not marks and not in_references and pct < 8.0 and page.count("[") >= 3 and len(self.entry.findall(page)) >= 3:
                kind = "reference"
            elif (
                self.matches("contents", body, low)
                or body.count(".") >= 40 and len(self.dots.findall(body)) >= 8
                or self.matches("table", body, low) and len(self.number.findall(body)) >= 35
            ):
                kind = "structural"
            elif s + a < MIN_TEXT or w < MIN_WORDS and s < MIN_SCRIPT:
                kind = "short"
            elif pct < 20.0 and (len(turns := self.matches("turn", body, low)) >= 2 or len(self.field.findall(body)) >= 6 or in_appendix and turns):
                kind = "source"
            else:
                kind = "analyzable"
                dominant = a >= DOMINANT_LETTERS and w >= DOMINANT_WORDS and pct < DOMINANT_PCT
                lines, said, sample = self.strongest_lines(counted)
                prose = lines >= 3 and said >= 30 and (len(re.findall(r"[.!?](?:\s|$)", sample)) >= 2 or bool(self.narrative.search(sample)))
                partial = dominant and bool(self.matches("proof", body, low)) or prose and not self.matches("turn", body, low) and bool(self.matches("section", body, low))
            yield pos, kind, s, a, w, dominant, partial


def classify_pages(docs: DataFrame, key: str, text: str, script: str = SCRIPT) -> DataFrame:
    """key, pos, kind, script, letters, words, dominant and partial for each page of each text."""

    def scan(batches):
        import pandas as pd

        reader = _Reader(script)
        for frame in batches:
            rows = [(k, *r) for k, t in zip(frame[key], frame[text]) for r in reader.pages(t or "")]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "script", "letters", "words", "dominant", "partial"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(scan, f"{key} {kind}, pos int, kind string, script long, letters long, words long, dominant boolean, partial boolean")


def _longest_run(places: Column) -> Column:
    """The longest run of consecutive numbers in a sorted array; 0 for none."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("longest"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"] + 1, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["longest"], run).alias("longest"))

    return F.aggregate(places, start, step, lambda a: a["longest"])


def paged_report(pages: DataFrame, key: str) -> DataFrame:
    """Pages of each class, dominant and partial pages, the longest dominant run, the script's share and the verdict."""
    n = lambda c: F.sum(c.cast("long"))
    use = F.col("kind") == "analyzable"
    script, letters = F.sum(F.when(use, F.col("script")).otherwise(0)), F.sum(F.when(use, F.col("letters")).otherwise(0))
    report = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), *(n(F.col("kind") == c).alias(f"{c}_pages") for c in CLASSES), n(F.col("dominant")).alias("dominant_pages"),
        n(F.col("partial")).alias("partial_pages"), (100.0 * script / F.greatest(script + letters, F.lit(1))).alias("script_pct"),
        _longest_run(F.array_sort(F.collect_set(F.when(F.col("dominant"), F.col("pos"))))).alias("longest_run"),
    )
    verdict = is_untranslated_paged(F.col("dominant_pages"), F.col("longest_run"), F.col("script_pct"), F.col("analyzable_pages"))
    return report.withColumns({"untranslated": verdict, "refused": F.col("refusal_pages") > 0, "script_pct": F.round("script_pct", 1)})
