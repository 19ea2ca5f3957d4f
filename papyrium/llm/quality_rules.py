"""Quality rules with host-level verdicts.

Each text is measured once (words, symbols, repeated lines, repeated 3-word windows). Rule failures
are summed by host, the failure rate of each host is shrunk towards the rate of all hosts with a
beta prior fitted to the spread between hosts (method of moments), and the verdict goes back to the
host's documents: on a host whose shrunk rate for a rule lies above the rate of all hosts by `STRICT_FROM`
standard deviations of its posterior, the rule is applied strictly, elsewhere only its lenient limit
counts. A document that passes the strict limits is kept on every host.

One pass over the texts in Arrow batches; only the measures, without text, are written to the shared
folder, summed by host (pre-aggregated, so a hot host is one row a task) and joined back. The
join is left to adaptive execution: broadcast while the host table is small, split when one host is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import SPACE, Spans, Texts, bounded, hash_spans, mix64, windows
from ._session import ship, table, written

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: Rule: (measure, per which measure, strict limit, lenient limit); it fails above the limit.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.1, 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3, 0.6),
    "word_length": ("word_chars", "n_words", 30.0, 100.0),
}
STRICT_FROM = 1.0
PRECISION = (1.0, 10_000.0)


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (row, hash) stands more than once."""
    key = mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), dtype=bool)
    out[order] = same
    return out


def measure(texts: Texts) -> dict[str, np.ndarray]:
    n = texts.n
    words = Spans(texts, SPACE)
    point = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=point[1:])
    chars = np.bincount(words.row, weights=point[words.ends] - point[words.starts], minlength=n).astype(np.int64)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True

    lines = Spans(texts, (0x0A,))
    filled = np.zeros(len(texts.data) + 1, dtype=np.int64)
    blank = np.zeros(256, dtype=bool)
    blank[list(SPACE)] = True
    np.cumsum(~blank[texts.data], out=filled[1:])
    real = np.flatnonzero(filled[lines.ends] > filled[lines.starts])
    row = lines.row[real]
    h = hash_spans(texts.data, lines.starts[real], lines.ends[real])
    n_lines = np.bincount(row, minlength=n)
    distinct = np.unique(mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_dup = n_lines - np.bincount(row[distinct], minlength=n)

    first, w = windows(words, words.hashes(), 3)
    hit = first[_repeats(words.row[first], w)]
    covered = np.zeros(len(words) + 3, dtype=bool)
    for i in range(3):
        covered[hit + i] = True
    n_repeat = np.bincount(words.row[covered[: len(words)]], minlength=n)
    return {"n_words": words.per_row(), "word_chars": chars, "n_symbols": texts.count(symbol), "n_dup_lines": n_dup, "n_lines": n_lines, "n_repeat_words": n_repeat}


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, host and the measures of each row, in one pass without a shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{m} long" for m in MEASURES)

    def scan(batches):
        for batch in bounded(batches):
            got = measure(Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["doc_id", "host", *MEASURES])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host {rows.schema['host'].dataType.simpleString()}, {kinds}")


def _over(rule: str, limit: float) -> Column:
    what, per, *_ = RULES[rule]
    return F.col(what) > F.lit(limit) * F.col(per)


def host_verdicts(measured: DataFrame) -> DataFrame:
    """A row a host: n, and for each rule the shrunk failure rate and whether it is strict there."""
    counts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(_over(r, RULES[r][2]).cast("long")).alias(r) for r in RULES))
    first = counts.agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES)).first()
    total = first["n"] or 0
    mean = {r: (first[r] or 0) / total if total else 0.0 for r in RULES}
    spread = counts.agg(*(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(mean[r]), F.lit(2.0))).alias(r) for r in RULES)).first()
    out = counts
    for r, m in mean.items():
        v = (spread[r] or 0.0) / total if total else 0.0
        s = min(max(m * (1 - m) / v - 1, PRECISION[0]), PRECISION[1]) if v > 0 else PRECISION[1]
        rate = (F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s))
        # How far the rate stands above that of all hosts, against the spread of the host's beta posterior.
        sure = F.sqrt(rate * (F.lit(1.0) - rate) / (F.col("n") + F.lit(s + 1.0)))
        out = out.withColumns({f"{r}_rate": rate, f"{r}_strict": rate - F.lit(m) > F.lit(STRICT_FROM) * sure})
    return out.select(F.col("host").alias("_host"), *(c for r in RULES for c in (f"{r}_rate", f"{r}_strict")))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, host, the measures, base_failed, each rule's shrunk
    rate on the host, and kept.

    Null text counts as no words and fails the base rule; a null host is a host of its own; rows
    that repeat an id are judged each by itself. Of equal words, lines or windows each counts; a rate
    that equals its limit passes. A very long text is measured whole, as one row of one task. Other columns of
    `docs`, whatever their names, are left aside. An empty table gives an empty result.
    """
    measured = written(measures(docs, id_col, host_col, text_col))
    both = measured.join(host_verdicts(measured), F.col("host").eqNullSafe(F.col("_host")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.lit(False)
    for r, (_, _, strict, lenient) in RULES.items():
        failed = failed | _over(r, lenient) | (F.col(f"{r}_strict") & _over(r, strict))
    return both.withColumn("base_failed", base).withColumn("kept", ~base & ~failed).drop("_host")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    over = lambda r, k: f"{RULES[r][0]} > {RULES[r][k]!r} * {RULES[r][1]}"
    sums = ", ".join(f"sum(CASE WHEN {over(r, 2)} THEN 1 ELSE 0 END) AS {r}" for r in RULES)
    means = ", ".join(f"sum({r}) / sum(n) AS m_{r}" for r in RULES)
    spreads = ", ".join(f"sum(n * pow({r} / n - m_{r}, 2)) / sum(n) AS v_{r}" for r in RULES)
    prior = ", ".join(f"m_{r}, CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {PRECISION[0]!r}), {PRECISION[1]!r}) ELSE {PRECISION[1]!r} END AS s_{r}" for r in RULES)
    rates = ", ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) AS r_{r}, s_{r}, m_{r}" for r in RULES)
    strict = ", ".join(f"r_{r} - m_{r} > {STRICT_FROM!r} * sqrt(r_{r} * (1 - r_{r}) / (n + s_{r} + 1)) AS strict_{r}" for r in RULES)
    failed = " OR ".join(f"({over(r, 3)}) OR (strict_{r} AND {over(r, 2)})" for r in RULES)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{word}') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j+1] || ' ' || ws[j+2])) AS g
  FROM w WHERE len(ws) >= 3
), many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM many, (VALUES (0), (1), (2)) t(k) WHERE c >= 2 GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '{word}') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)
), host AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM m GROUP BY source),
mean AS (SELECT {means} FROM host), spread AS (SELECT {spreads} FROM host, mean),
prior AS (SELECT {prior} FROM mean, spread),
rate AS (SELECT source AS host, n, {rates} FROM host, prior),
verdict AS (SELECT host, {strict} FROM rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) x
JOIN verdict ON source IS NOT DISTINCT FROM host
"""


SQL = _sql()
