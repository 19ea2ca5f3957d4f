"""Health of TeX compilations, from their logs: what failed, what only needs another run.

A log is wrapped at a fixed width; records are put together again before anything is looked for. All native: logs are
independent rows, warnings are exploded only to meet the labels of their run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col

# Messages of the engines, and names that only one of them knows (another goes on without them).
DONE = r"Output written on \S+\.(?:xdv|pdf)"
UNKNOWN = "Undefined control sequence"
BAD_NUMBER = "Missing number, treated as zero"
CITATION_WARNING = r"(?<!Package natbib Warning: )Citation [`']([^'\n]*)'[^\n]* undefined"
NATBIB_WARNING = r"Package natbib Warning: Citation [`']([^'\n]*)'[^\n]* undefined"
REFERENCE_WARNING = r"Reference [`']([^'\n]*)'[^\n]* undefined"
SUMMARY = "There were undefined references"
PRIMITIVES = (
    "pdfoutput", "pdfgentounicode", "pdfinfoomitdate", "pdftrailerid", "pdfsuppressptexinfo", "pdfminorversion", "pdfcompresslevel", "pdfobjcompresslevel",
    "pdfpagewidth", "pdfpageheight", "pdfhorigin", "pdfvorigin", "pdfmapline", "pdfinfo", "pdfcatalog", "pdfobj", "pdfximage", "pdfrefximage", "pdfannot",
    "pdfsavepos", "pdfliteral", "pdfpageattr", "pdfinclusioncopyfonts",
)
WIDTH, NEAR_ERROR = 79, 300


def records(log, width: int = WIDTH) -> Column:
    """The log with its wrapped lines joined: a line of exactly `width` characters goes on in the next."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(log), F.lit("")), r"\r\n?", "\n"), rf"(?m)^([^\n]{{{width}}})\n", "$1")


def unknown_commands(log) -> Column:
    """What follows each report of an unknown command, up to 300 characters; a report tells the command on its next line."""
    return F.regexp_extract_all(_col(log), F.lit(rf"{UNKNOWN}(?=([\s\S]{{0,{NEAR_ERROR}}}))"), F.lit(1))


def health(logs: DataFrame, run: str = "run", log: str = "log", strict: bool = False, width: int = WIDTH) -> DataFrame:
    """A row a run: complete (the output was written), failures and warnings (arrays), healthy, and stale_only.

    Failures: unknown commands other than another engine's primitives, bad numbers; if strict, undefined citations and
    references too, which are warnings otherwise. stale_only: nothing failed but references that another run may
    resolve. Null log: incomplete. An incomplete run is never healthy.
    """
    primitive = r"\\(?:" + "|".join(PRIMITIVES) + r")\b"
    rows = logs.select(run, records(log, width).alias("_log")).withColumn("_unknown", unknown_commands("_log"))
    text = F.col("_log")
    cites, refs, summed = text.rlike(CITATION_WARNING), text.rlike(REFERENCE_WARNING), F.contains(text, F.lit(SUMMARY))
    fatal = F.exists("_unknown", lambda x: ~x.rlike(primitive))
    number = F.contains(text, F.lit(BAD_NUMBER))
    name = lambda test, said: F.when(test, F.lit(said))
    soft = [name(cites, "undefined citation"), name(refs, "undefined reference"), name(summed, "undefined references")]
    hard = [name(fatal, "undefined control sequence"), name(number, "missing number")]
    mild = [name(text.rlike(NATBIB_WARNING), "natbib undefined"), name(F.exists("_unknown", lambda x: x.rlike(primitive)), "pdftex primitive undef")]
    failures, warnings = (hard + soft, mild) if strict else (hard, mild + soft)
    out = rows.select(
        run,
        text.rlike(DONE).alias("complete"),
        F.array_compact(F.array(*failures)).alias("failures"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
        (~fatal & ~number & ~cites & (refs | summed)).alias("stale_only"),
    )
    return out.withColumn("healthy", F.col("complete") & (F.size("failures") == 0))


def warned(logs: DataFrame, run: str = "run", log: str = "log", width: int = WIDTH) -> DataFrame:
    """(run, kind, name): references and citations that a run calls undefined, each once."""
    text = records(log, width)
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    both = F.concat(found("reference", REFERENCE_WARNING), found("citation", r"Citation [`']([^'\n]*)'[^\n]* undefined"))
    return logs.select(run, F.explode(F.array_distinct(both)).alias("_one")).select(run, "_one.*")


def missing_labels(logs: DataFrame, labels: DataFrame, run: str = "run", log: str = "log", label: str = "label", width: int = WIDTH) -> DataFrame:
    """(run, name): references called undefined that no label of the same run defines, so that no further run helps."""
    names = warned(logs, run, log, width).filter("kind = 'reference'").select(run, "name")
    return names.join(labels.select(run, F.col(label).alias("name")), [run, "name"], "left_anti")


def needs_only_another_run(logs: DataFrame, labels: DataFrame, run: str = "run", log: str = "log", label: str = "label", width: int = WIDTH) -> DataFrame:
    """(run, reruns): whether a run is stale only and every reference it misses is a label of its sources."""
    lost = missing_labels(logs, labels, run, log, label, width).groupBy(run).agg(F.count(F.lit(1)).alias("_lost"))
    state = health(logs, run, log, width=width).select(run, "stale_only")
    return state.join(lost, run, "left").select(run, (F.col("stale_only") & F.col("_lost").isNull()).alias("reruns"))
