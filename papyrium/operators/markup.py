"""Operators over markup: fields of pages, ordered links, nesting, and references to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip_tags, unescape_entities


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title, language attribute and length of the text without tags."""
    title = unescape_entities(squeeze(strip_tags(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))))
    return pages.select(key, title.alias("title"), F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"), F.length(strip_tags(html)).cast("long").alias("text_chars"))


def ordered_links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = '<a href="([^"]*)"') -> DataFrame:
    """Distinct links of each page with the place of their first stand, from 0."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "href"))
    return each.groupBy(key, "href").agg(F.min("pos").alias("first_pos"))


def board_rows(pages: DataFrame, key: str, html: str, limit: int = 50) -> DataFrame:
    """Leaderboard rows of scraped pages: ids in order, the title after each, and the votes nearby.

    Pages without links fall back to bare ids.
    """
    block = r'(?s)href="/papers/(\d{4}\.\d{4,5})"(.*?)(?=href="/papers/|\Z)'
    ids = F.regexp_extract_all(html, F.lit(block), F.lit(1))
    rest = F.regexp_extract_all(html, F.lit(block), F.lit(2))
    bare = F.regexp_extract_all(html, F.lit(r"\b(\d{4}\.\d{4,5})\b"), F.lit(1))
    linked = F.size(ids) > 0
    rows = F.when(linked, F.arrays_zip(ids.alias("id"), rest.alias("rest"))).otherwise(F.transform(bare, lambda x: F.struct(x.alias("id"), F.lit("").alias("rest"))))
    each = pages.select(key, F.posexplode(rows).alias("pos", "x")).select(key, "pos", "x.*")
    title = unescape_entities(squeeze(strip_tags(F.regexp_extract("rest", "(?s)<h3[^>]*>(.*?)</h3>", 1))))
    votes = F.regexp_extract("rest", r"<div[^>]*>\s*(\d+)\s*</div>", 1).try_cast("int")
    named = each.withColumns({"title": title, "upvotes": F.coalesce(votes, F.lit(0))})
    # An id stands once: the place of its first stand, the first title and votes that it shows.
    folded = named.groupBy(key, "id").agg(
        F.min("pos").alias("pos"), F.min_by("title", F.when(F.col("title") != "", F.col("pos"))).alias("title"), F.max("upvotes").alias("upvotes")
    )
    w = Window.partitionBy(key).orderBy("pos")
    return folded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


#: The parts of an abstract page.
ABSTRACT_PAGE = {
    "title": r'(?s)<h1 class="title mathjax"[^>]*>(?:<span[^>]*>Title:</span>\s*)?(.*?)</h1>',
    "abstract": r'(?s)<blockquote class="abstract mathjax"[^>]*>(?:<span[^>]*>Abstract:</span>\s*)?(.*?)</blockquote>',
    "authors": r'(?s)<div class="authors"[^>]*>(.*?)</div>',
    "submitted": r"Submitted on ([\w\s,]+?)(?:\s*\(|\s*\[)",
}


def abstract_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, abstract, authors and date of an abstract page; blanks where a part is missing or the page is null."""
    part = lambda name: F.btrim(strip_tags(F.coalesce(F.regexp_extract(html, ABSTRACT_PAGE[name], 1), F.lit(""))), F.lit(" \t\n\r\f\u000b"))
    return pages.select(
        key, part("title").alias("title"), squeeze(part("abstract")).alias("abstract"),
        F.btrim(squeeze(part("authors")), F.lit(", ")).alias("authors"), part("submitted").alias("submitted"),
    )


def nesting(pages: DataFrame, key: str = "page_id", html: str = "html", tags: str = "div|ul|article|nav|p") -> DataFrame:
    """Open and close tags of each page in order with the running depth (native, depth only)."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"<(/?(?:{tags}))\b"), F.lit(1))).alias("pos", "tag"))
    step = F.when(F.col("tag").startswith("/"), -1).otherwise(1)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("depth", F.sum(step).over(w))


def environment_stack(docs: DataFrame, key: str, text: str, begin: str = r"\\begin\{([A-Za-z*]+)\}", end: str = r"\\end\{([A-Za-z*]+)\}") -> DataFrame:
    """For each line the innermost open environment after it and the depth, by a stack within each text."""
    import re

    b, e = re.compile(begin), re.compile(end)

    def walk(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for k, t in zip(frame[key], frame[text]):
                stack: list[str] = []
                for n, line in enumerate((t or "").split("\n"), 1):
                    marks = sorted([(m.start(), True, m[1]) for m in b.finditer(line)] + [(m.start(), False, m[1]) for m in e.finditer(line)])
                    for _, opening, name in marks:
                        if opening:
                            stack.append(name)
                        elif name in stack:
                            while stack and stack.pop() != name:
                                pass
                    out.append((k, n, stack[-1] if stack else None, len(stack)))
            yield pd.DataFrame(out, columns=[key, "line_no", "env", "depth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(walk, f"{key} {kind}, line_no int, env string, depth int")


def resolve_references(references: DataFrame, labels: DataFrame, scope: str, ref: str = "ref", label: str = "label") -> DataFrame:
    """Undefined references with the only label of their scope that begins with them, if there is one.

    Slashes count as colons. References that are defined are left out; ambiguous ones get null.
    """
    undefined = references.join(labels.withColumnRenamed(label, ref), [scope, ref], "left_anti").distinct()
    plain = F.replace(F.col(ref), F.lit("/"), F.lit(":"))
    near = undefined.join(labels, scope).filter(F.col(label).startswith(plain))
    found = near.groupBy(scope, ref).agg(F.countDistinct(label).alias("_n"), F.min(label).alias("resolved")).filter("_n = 1").drop("_n")
    return undefined.join(found, [scope, ref], "left")


def fuzzy_labels(pairs: DataFrame, ref: str = "ref", candidates: str = "candidates", least: float = 0.78, margin: float = 0.08) -> DataFrame:
    """`resolved`: of an array of candidates the one most like the reference, if it is alike enough and
    clearly ahead of the second."""
    import difflib

    @F.pandas_udf("string")
    def best(refs, lists):
        import pandas as pd

        def one(r, names):
            scored = sorted(((difflib.SequenceMatcher(None, r, n).ratio(), n) for n in names), reverse=True) if r is not None and names is not None else []
            if not scored or scored[0][0] < least or (len(scored) > 1 and scored[0][0] - scored[1][0] < margin):
                return None
            return scored[0][1]

        return pd.Series([one(r, c) for r, c in zip(refs, lists)], dtype="object")

    return pairs.withColumn("resolved", best(ref, candidates))


def citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cited keys of each text with the place of their first stand."""
    lists = F.regexp_extract_all(text, F.lit(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^{}]*)\}"), F.lit(1))
    each = docs.select(key, F.posexplode(F.flatten(F.transform(lists, lambda x: F.split(x, ",")))).alias("pos", "cited"))
    return each.withColumn("cited", F.trim("cited")).filter("cited <> ''").groupBy(key, "cited").agg(F.min("pos").alias("first_pos"))


def missing_citations(cited: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Cited keys without a bibliography entry."""
    return cited.join(entries, [key, "cited"], "left_anti")
