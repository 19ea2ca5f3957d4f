"""Benchmark decontamination by a broadcast hash set of n-grams.

Words are maximal runs of digits, letters a-z and any non-ASCII characters of the text in lower case
(A-Z only). A window is ten consecutive words of a benchmark item, or all words of a shorter one.
Every document is scanned once against the set of window hashes; each hash that hits is verified
word by word against an item that it came from, so a chance collision can't mark a word.

The set is broadcast only in blocks of a bounded number of benchmark words (`block_words`); a benchmark
beyond the bound takes one scan for each block, and the hits of a document are merged by its key.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batch import Spans, Texts, bounded, sequence_hash
from ._session import beside, quoted, ship, table, without, written

WINDOW = 10
BLOCK_WORDS = 2_000_000
DELIMITERS = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
_BITS = 22


class _Block:
    """Windows of some items in flat arrays: about 50 bytes for each word of the benchmark.

    The words' bytes and hashes stand one after another; a window of length m is the place of its first word.
    By length there are the sorted distinct window hashes, for each a place to verify it at, and the items
    that hold it (`items[first[k] : first[k + 1]]`, by number).
    """

    def __init__(self, names: list[str], texts: Texts, window: int):
        words = Spans(texts, DELIMITERS)
        self.names = names
        self.data, self.starts, self.ends, self.hashes = texts.data, words.starts, words.ends, words.hashes()
        self.by_length = {}
        sizes = words.per_row()
        length = np.minimum(sizes, window)
        for m in np.unique(length[length > 0]).tolist() if len(length) else []:
            # Places whose next m words are one item's, in items of this window length.
            at = np.arange(len(words))
            at = at[(length[words.row] == m) & (at + m <= words.last[words.row])]
            h = sequence_hash(self.hashes, m)[at]
            order = np.lexsort((at, words.row[at], h))
            h, at, item = h[order], at[order], words.row[at][order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            own = new | np.concatenate([[True], item[1:] != item[:-1]])  # an item once for each window
            keys, place = h[new], at[new]
            first = np.append(np.flatnonzero(new[own]), own.sum())
            near = np.zeros(1 << _BITS, dtype=bool)
            near[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_length[m] = keys, near, place.astype(np.int64), item[own].astype(np.int32), first

    def same(self, place: int, m: int, texts: Texts, words: Spans, at: int) -> bool:
        """Whether the m words from `place` on are those of the text from `at` on, byte by byte."""
        return all(
            np.array_equal(self.data[self.starts[place + i] : self.ends[place + i]], texts.data[words.starts[at + i] : words.ends[at + i]])
            for i in range(m)
        )


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Items with words in a fixed order, fetched a partition at a time, in blocks of at most `block_words`."""
    rows = bench.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text")).filter("text IS NOT NULL AND item IS NOT NULL")
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).filter("n > 0")
    names, texts, used = [], [], 0
    for r in counted.orderBy("item", "text").toLocalIterator():
        if names and used + r["n"] > block_words:
            yield _Block(names, Texts(pa.array(texts, type=pa.large_string())).lowered(), window)
            names, texts, used = [], [], 0
        names.append(r["item"])
        texts.append(r["text"])
        used += r["n"]
    if names:
        yield _Block(names, Texts(pa.array(texts, type=pa.large_string())).lowered(), window)


def _hits(block: _Block, texts: Texts, words: Spans):
    """Marked words, and the (row, item) pairs found."""
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    pairs = []
    if not len(words):
        return hit[:0].astype(bool), []
    h = words.hashes()
    for m, (keys, near, place, items, first) in block.by_length.items():
        if len(words) < m:
            continue
        w = sequence_hash(h, m)
        maybe = np.flatnonzero(near[(w >> np.uint64(64 - _BITS)).astype(np.int64)])
        maybe = maybe[words.row[maybe] == words.row[maybe + m - 1]]
        at = np.searchsorted(keys, w[maybe])
        at[at == len(keys)] = 0
        true = keys[at] == w[maybe]
        maybe, at = maybe[true], at[true]
        # Every word's hash is compared, and byte by byte the first of a batch's hits on a window.
        for i in range(m):
            good = h[maybe + i] == block.hashes[place[at] + i]
            maybe, at = maybe[good], at[good]
        _, one, back = np.unique(at, return_index=True, return_inverse=True)
        good = np.array([block.same(int(place[at[i]]), m, texts, words, int(maybe[i])) for i in one.tolist()], dtype=bool)[back]
        maybe, at = maybe[good], at[good]
        np.add.at(hit, maybe, 1)
        np.add.at(hit, maybe + m, -1)
        if len(at):
            n = first[at + 1] - first[at]
            begin = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both = np.stack([np.repeat(words.row[maybe], n), items[begin + np.arange(int(n.sum()))]], axis=1)
            pairs += np.unique(both, axis=0).tolist()
    return np.cumsum(hit[:-1]) > 0, pairs


def find_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, action: str = "report") -> DataFrame:
    """All rows and columns of `docs`, plus n_words, n_hit, items (sorted array of item ids as strings)
    and contaminated.

    action: "report" leaves the texts; "spans" takes each maximal run of hit words out of the text,
    from its first to its last character; "documents" drops contaminated rows.

    Null texts have no words. Items without words or id match nothing; items that repeat an id count
    once. Rows of `docs` that repeat an id are judged each by itself; of equal windows in several items all
    items count. Very long texts are scanned whole. Columns of `docs` with the names of results are replaced,
    others pass through, whatever their names. An empty table gives an empty result, an empty benchmark marks
    nothing.
    """
    spark = ship(docs.sparkSession)
    new = ["n_words", "n_hit", "items", "contaminated"]
    docs = without(docs, *new)
    blocks = _blocks(bench, item_col, item_text, window, block_words)
    first = next(blocks, None) or _Block([], Texts(pa.array([], type=pa.large_string())), window)
    second = next(blocks, None)
    rows, own = beside(docs, text_col)

    def scanner(block):
        def scan(batches):
            own = block.value
            for batch in bounded(batches, "text"):
                texts = Texts(batch.column("text"))
                words = Spans(texts.lowered(), DELIMITERS)
                hit, pairs = _hits(own, words.texts, words)
                items = [[] for _ in range(texts.n)]
                for row, j in pairs:
                    items[row].append(own.names[j])
                items = [sorted(set(x)) for x in items]
                runs = [[] for _ in range(texts.n)]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    while a < b:  # a run of hit words may go on into the next row
                        row = int(words.row[a])
                        c = min(b, int(words.last[row]))
                        runs[row] += (int(words.starts[a] - texts.starts[row]), int(words.ends[c - 1] - texts.starts[row]), int(a - words.first[row]), int(c - words.first[row]))
                        a = c
                n_hit = np.bincount(words.row[hit], minlength=texts.n) if len(words) else np.zeros(texts.n, dtype=np.int64)
                extra = [pa.array(words.per_row().astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(items, type=pa.list_(pa.string())), pa.array(runs, type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n_words", "n_hit", "items", "runs"])

        return scan

    kinds = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("runs", T.ArrayType(T.LongType()))))])

    def one(block):
        return rows.mapInArrow(scanner(spark.sparkContext.broadcast(block)), kinds)

    out = one(first)
    if second is not None:
        # Beyond the bound: a scan for each block; the same row meets itself by id and text.
        id_ = F.col("row").getField(id_col)
        key = [id_.alias("doc"), F.xxhash64("text").alias("of")]
        for block in itertools.chain((second,), blocks):
            more = written(one(block).filter(F.size("items") > 0).select(*key, F.col("runs").alias("more"), F.col("items").alias("others"))).groupBy("doc", "of").agg(F.first("more").alias("more"), F.first("others").alias("others"))
            joined = out.join(more, id_.eqNullSafe(F.col("doc")) & F.xxhash64("text").eqNullSafe(F.col("of")), "left")
            out = joined.withColumns({"runs": F.when(F.col("more").isNull(), F.col("runs")).otherwise(F.concat("runs", "more")), "items": F.array_sort(F.array_union("items", F.coalesce("others", F.array().cast("array<string>"))))}).drop("doc", "of", "more", "others")
    if action == "spans" or second is not None:

        @F.pandas_udf("text string, n_hit long")
        def settle(text, runs):
            import pandas as pd

            texts, hits = [], []
            for t, r in zip(text, runs):
                merged = []
                for a, b, i, j in sorted(zip(*[iter([int(x) for x in r])] * 4)):
                    if merged and i <= merged[-1][3]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2], max(merged[-1][3], j))
                    else:
                        merged.append((a, b, i, j))
                hits.append(sum(j - i for _, _, i, j in merged))
                if merged:
                    raw, at, kept = t.encode(), 0, []
                    for a, b, _, _ in merged:
                        kept.append(raw[at:a])
                        at = b
                    t = b"".join([*kept, raw[at:]]).decode()
                texts.append(t)
            return pd.DataFrame({"text": texts, "n_hit": hits})

        out = out.withColumn("settled", settle("text", "runs")).withColumn("n_hit", F.col("settled.n_hit"))
    if action == "documents":
        out = out.filter(F.col("n_hit") == 0)
    if action == "spans":
        own[text_col] = F.col("settled.text").alias(text_col)
    return out.select(*own.values(), "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS m, unnest(list_transform(range(1, len(ws) - least({WINDOW}, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least({WINDOW}, len(ws)) - 1], ' '))) AS g
  FROM b WHERE len(ws) > 0
), lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda j: array_to_string(ws[j:j + m - 1], ' '))) AS g
  FROM d, lengths WHERE len(ws) >= m
), hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
