"""Text quality: line and page measures, verdicts, runs, carried state, bins and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, letters, script_chars, script_share, tokens


def lines(docs: DataFrame, item: str = "doc_id", text: str = "text", pattern: str = "\n", keep: list[str] | None = None) -> DataFrame:
    """item, pos (from 1) and line of each line."""
    return docs.select(item, *(keep or []), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), pattern)).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def pages(docs: DataFrame, item: str = "doc_id", text: str = "text") -> DataFrame:
    """item, pos and line (the page's text) of each form-feed page; a blank last page is dropped."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), "\f")
    cut = F.when((F.size(cut) > 1) & (F.trim(F.element_at(cut, -1)) == ""), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return docs.select(item, F.posexplode(cut).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def script_metrics(docs: DataFrame, item: str = "doc_id", text: str = "text", script: str = CJK) -> DataFrame:
    """Letters, script characters, tokens and the script's share of each text."""
    return docs.select(item, letters(text).cast("long").alias("letters"), script_chars(text, script).cast("long").alias("script_chars"), F.size(tokens(text)).cast("long").alias("tokens"), F.round(script_share(text, script), 1).alias("script_pct"))


def share_bin(pct: Column) -> Column:
    return F.when(pct < 20, "<20").when(pct < 40, "20-39").when(pct < 60, "40-59").when(pct < 80, "60-79").otherwise("80+")


def count_bin(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise("51+")


def word_bin(n: Column) -> Column:
    return F.when(n <= 15, "8-15").when(n <= 30, "16-30").otherwise("31+")


def line_flags(each: DataFrame, script: str = CJK, line: str = "line") -> DataFrame:
    """Counts and flags of each line."""
    out = each.withColumns({"letters": letters(line), "cjk": script_chars(line, script), "words": F.size(tokens(line))})
    broad = (F.col("words") >= 8) & (F.col("letters") >= 50)
    return out.withColumns(
        {
            "prose": (F.col("letters") >= 40) | (F.col("cjk") >= 10),
            "broad": broad,
            "mixed": broad & (F.col("cjk") >= 8),
            "dominant": broad & ((F.col("cjk") < 8) | (F.col("words") >= F.col("cjk"))),
            "long": (F.col("letters") >= 80) & (F.col("cjk") <= 5) & (F.col("words") >= 12),
            "very_long": (F.col("letters") >= 180) & (F.col("cjk") <= 8) & (F.col("words") >= 24),
        }
    )


def document_report(flagged: DataFrame, item: str = "doc_id") -> DataFrame:
    """Sums of the line flags and the script's share, a row a document."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return flagged.groupBy(item).agg(
        F.count(F.lit(1)).alias("lines"), n("prose").alias("prose_lines"), n("broad").alias("broad_english"), n("mixed").alias("mixed_language"),
        n("dominant").alias("english_dominant"), n("long").alias("long_english"), n("very_long").alias("very_long_english"),
        F.sum("letters").alias("letters"), F.sum("cjk").alias("cjk"),
        F.round(100.0 * F.sum("cjk") / F.greatest(F.sum("cjk") + F.sum("letters"), F.lit(1)), 1).alias("cjk_pct"),
    )


def is_untranslated(report_prefix: str = "", mixed_clauses: Column | None = None) -> Column:
    """The document verdict: any of seven limits."""
    c = lambda k: F.col(report_prefix + k)
    long, pct = c("long_english"), c("cjk_pct")
    mixed = mixed_clauses if mixed_clauses is not None else F.lit(0)
    return (
        (long >= 20) | (c("very_long_english") >= 3) | ((long >= 10) & (pct < 70)) | ((long >= 6) & (pct < 55))
        | ((pct < 45) & (long >= 4)) | ((pct < 15) & (c("prose_lines") >= 20)) | (mixed >= 2)
    )


def is_untranslated_paged(dominant: Column, run: Column, pct: Column, analyzable: Column) -> Column:
    """The paged verdict: sustained foreign pages, many of them, or some in a text of little script."""
    fraction = dominant / F.greatest(analyzable, F.lit(1))
    return (
        ((dominant >= 3) & (pct < 12)) | ((dominant >= 3) & (pct < 25) & (fraction >= 0.30)) | (run >= 4) | (dominant >= 10)
        | ((dominant >= 5) & (pct < 30) & (fraction >= 0.20))
    )


def longest_run(flagged: DataFrame, flag: str, item: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The longest run of consecutive flagged positions of each item that has one."""
    hit = flagged.filter(F.col(flag)).select(item, pos).distinct()
    island = F.col(pos) - F.row_number().over(Window.partitionBy(item).orderBy(pos))
    runs = hit.withColumn("_run", island).groupBy(item, "_run").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(item).agg(F.max("run").alias("longest_run"))


def strongest_run(flagged: DataFrame, flag: str, words: str = "words", item: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The run with most lines, then most words, then the earliest start."""
    hit = flagged.filter(F.col(flag))
    island = F.col(pos) - F.row_number().over(Window.partitionBy(item).orderBy(pos))
    runs = hit.withColumn("_run", island).groupBy(item, "_run").agg(F.count(F.lit(1)).alias("run_lines"), F.sum(words).alias("run_words"), F.min(pos).alias("run_start"))
    best = F.max(F.struct("run_lines", "run_words", (-F.col("run_start")).alias("back"))).alias("x")
    return runs.groupBy(item).agg(best).select(item, F.col("x.run_lines").alias("run_lines"), F.col("x.run_words").alias("run_words"), (-F.col("x.back")).alias("run_start"))


def carry_state(marked: DataFrame, marker: str, item: str = "doc_id", pos: str = "pos", state: str = "state") -> DataFrame:
    """The last non-null marker up to each line, itself included."""
    w = Window.partitionBy(item).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(state, F.last(marker, ignorenulls=True).over(w))


def line_context(flagged: DataFrame, flag: str, before: int = 2, after: int = 2, first: int = 10, item: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """The lines around each of the first hits of an item."""
    w = Window.partitionBy(item).orderBy(pos)
    around = F.array_join(F.collect_list(line).over(w.rowsBetween(-before, after)), "\n")
    n = F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumns({"context": around, "hit": n}).filter(F.col(flag) & (F.col("hit") <= first)).select(item, pos, "hit", "context")


def lower_percentile(values: Column, ratio: float) -> Column:
    """The value at the floor of (n - 1) * ratio of the sorted values; 0 for none."""
    ordered = F.array_sort(values)
    at = F.floor((F.size(values) - 1) * F.lit(ratio)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(ordered, at)).otherwise(0)


def length_profile(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """Minimum, median, lower 90th percentile, maximum and counts below 80 and 160 of `size`.

    Equal sizes are counted first, so that a group is its distinct sizes and never all its rows.
    """
    counted = df.groupBy(*by, size).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col(size)))
    mid = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2.0
    below = lambda n: F.sum(F.when(F.col(size) < n, F.col("_n")).otherwise(0))
    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.min(size).alias("min_len"), mid.alias("median_len"), at(F.floor((F.col("_all") - 1) * 0.9)).alias("p90_len"),
        F.max(size).alias("max_len"), below(80).alias("under_80"), below(160).alias("under_160"),
    )


def top_tokens(docs: DataFrame, by: list[str], text: str = "text", n: int = 50) -> DataFrame:
    """The most frequent lower-case tokens of each group, ties by token."""
    each = docs.select(*by, F.explode(tokens(text)).alias("token")).withColumn("token", F.lower("token"))
    counted = each.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("token"))
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_samples(df: DataFrame, by: list[str], pos: str, text: str, k: int = 5, limit: int = 220) -> DataFrame:
    """The first `k` texts of each group by position, cut to `limit` characters."""
    w = Window.partitionBy(*by).orderBy(pos)
    kept = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring(text, 1, limit).alias("t")))), lambda x: x["t"]).alias("samples"))
