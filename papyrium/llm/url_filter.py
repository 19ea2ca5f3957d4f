"""URL filters: host and path rules, then a character language-model ratio.

A URL that a rule fits takes the rule's verdict. The rest is judged by two smoothed variable-order Markov
models over characters, one of accepted and one of rejected URLs: the difference of log-likelihoods, divided
by the length, against a threshold that is calibrated on labelled URLs that the models haven't seen.

The labels are the rules' own verdicts unless a table of labels is given. Models are fitted on a bounded,
hash-chosen sample of labelled URLs (`sample_rows` of each class); the scan over all URLs is a
map that reads no other column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._charlm import CharModels
from ._session import ship, table
from .line_dedup import ascii_lower

#: (verdict, host, path): the host and all its subdomains, paths that start with the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
SAMPLE_ROWS = 20_000
CLASSES = ["allow", "block"]


def host_of(url: Column) -> Column:
    """From the first :// to / ? # or the end, A-Z in lower case; empty for null and without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits; of equal length the last in the list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class UrlModel:
    def __init__(self, models: CharModels, threshold: float):
        self.models, self.threshold = models, threshold

    def ratio(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood of acceptance minus that of rejection, a character."""
        if len(self.models.classes) < 2:
            return np.zeros(len(urls))
        logs, sizes = self.models.log_probs(urls)
        return (logs[:, 0] - logs[:, 1]) / np.maximum(sizes, 1)


def fit(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> UrlModel:
    """Fits on about `sample_rows` rows of each class of (text, verdict), a fifth kept to calibrate.

    The threshold splits the kept part with the least mean error of both classes, in the middle of
    the best range. One class only, or none: the threshold accepts everything that isn't ruled.
    """
    counts = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.get(c) for c in CLASSES):
        return UrlModel(CharModels([], order), -1.0)
    share = F.create_map(*(F.lit(x) for c in CLASSES for x in (c, min(1.0, sample_rows / counts[c]))))
    unit = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = labelled.filter(unit < share[F.col("verdict")]).groupBy("verdict", "text").agg(F.count(F.lit(1)).alias("n"), F.first(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(5)) == 0).alias("held")).toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("verdict", "held", "text", "n"))))
    samples = []
    for c in CLASSES:
        own = [(t, n) for v, h, t, n in rows if v == c and not h] or [(t, n) for v, h, t, n in rows if v == c]
        samples.append(([t for t, _ in own], np.array([n for _, n in own], dtype=np.float64)))
    if not all(s[0] for s in samples):
        return UrlModel(CharModels([], order), -1.0)
    model = UrlModel(CharModels(CLASSES, order, kind="witten-bell").fit(samples), 0.0)
    held = [(v, t, n) for v, h, t, n in rows if h]
    if {v for v, _, _ in held} == set(CLASSES):
        r = model.ratio([t for _, t, _ in held])
        n = np.array([x for _, _, x in held], dtype=np.float64)
        good = np.array([v == "allow" for v, _, _ in held])
        order_ = np.argsort(r, kind="stable")
        r, n, good = r[order_], n[order_], good[order_]
        missed = np.concatenate([[0.0], np.cumsum(np.where(good, n, 0.0))]) / n[good].sum()
        passed = 1.0 - np.concatenate([[0.0], np.cumsum(np.where(good, 0.0, n))]) / n[~good].sum()
        error = missed + passed
        best = np.flatnonzero(error <= error.min() + 1e-12)
        mid = int(best[len(best) // 2])
        edges = np.concatenate([[r[0] - 1e-6], r, [r[-1] + 1e-6]])
        model.threshold = float((edges[mid] + edges[mid + 1]) / 2)
    return model


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each row of `pages`: page_id, host, path, rule (null if none fits), ratio and verdict.

    labels: (text, verdict) to fit on instead of the rules' verdicts; text is host + path. Null URLs and
    those without :// have empty hosts and paths and are judged by the models like others. Repeated
    rows are judged alike; other columns are left aside; an empty table gives an empty result.
    """
    spark = ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        labels = ruled.filter("_r IS NOT NULL").select(F.concat("host", "path").alias("text"), F.col("_r.verdict").alias("verdict"))
    model = spark.sparkContext.broadcast(fit(labels, sample_rows=sample_rows))

    @F.pandas_udf("double")
    def ratio(text):
        import pandas as pd

        own, out = model.value, []
        for a in range(0, len(text), 5000):
            out.append(own.ratio(text.iloc[a : a + 5000].tolist()))
        return pd.Series(np.concatenate(out) if out else np.zeros(0), index=text.index)

    scored = ruled.withColumn("ratio", ratio(F.concat("host", "path")))
    own = F.when(F.col("ratio") >= F.lit(model.value.threshold), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), "ratio", F.coalesce(F.col("_r.verdict"), own).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")
