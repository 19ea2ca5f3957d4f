"""Substring join: which passages stand in which texts.

All texts of a batch are looked at as one array of bytes. The first bytes of each passage (1 to 8, 16 or 32, by its
length) are one number; the same numbers of all places of the texts are made by array operations, held against a table of the
passages', and where one is equal the whole passage is compared. UTF-8 is read from the start of a character only, so bytes do. Passages are
taken in blocks of a bounded number of characters; one block is broadcast at a time, and a table of passages beyond the
bound takes a scan for each block. No pair of a text and a passage is tested by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches

#: Characters of the passages in one block.
BLOCK_CHARS = 1_000_000
#: Bytes of text that a task looks at together; a longer text is looked at alone.
SLICE_BYTES = 1 << 18
_NOT_TEXT = b"\xff"  # stands in no UTF-8
_HEADS = (32, 16, 8, 7, 6, 5, 4, 3, 2, 1)
_BITS = 20


def _blocks(passages: DataFrame, item: str, text: str, block_chars: int):
    own, used = [], 0
    rows = passages.select(item, text).filter(F.col(text) != "").orderBy(item, text)
    for r in rows.toLocalIterator():
        if own and used + len(r[text]) > block_chars:
            yield own
            own, used = [], 0
        own.append((r[item], r[text]))
        used += len(r[text])
    if own:
        yield own


def contained(docs: DataFrame, passages: DataFrame, key: str, item: str, text: str, passage_text: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key and item of each passage that a text holds, once a pair. Empty passages and nulls match nothing."""
    spark = bounded_batches(docs.sparkSession)
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, {item} {passages.schema[item].dataType.simpleString()}"
    out = None
    for block in _blocks(passages, item, passage_text or text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            import pandas as pd

            find = _Passages(shared.value)
            for frame in batches:
                rows = [(k, t.encode()) for k, t in zip(frame[key], frame[text]) if t]
                hits = [(part[row][0], i) for part in _slices(rows) for row, i in find.within([t for _, t in part])]
                yield pd.DataFrame(hits, columns=[key, item])

        own = docs.select(key, text).mapInPandas(scan, kinds)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], kinds)


def _slices(rows: list[tuple]):
    part, used = [], 0
    for row in rows:
        if part and used + len(row[1]) > SLICE_BYTES:
            yield part
            part, used = [], 0
        part.append(row)
        used += len(row[1])
    if part:
        yield part


def _heads(data: np.ndarray, m: int) -> np.ndarray:
    """A number for the m bytes from each place on: those bytes themselves up to 8, beyond that a hash of them."""
    n = len(data) - m + 1
    eight = np.zeros(max(n + m - min(m, 8), 0), dtype=np.uint64)
    for i in range(min(m, 8)):
        eight |= data[i : i + len(eight)].astype(np.uint64) << np.uint64(8 * i)
    out = eight[:n].copy()
    for i in range(8, m, 8):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(32))) + eight[i : i + n]
    return out


class _Passages:
    """The passages of a block by the length and the number of their first bytes."""

    def __init__(self, block: list[tuple]):
        ids: dict[bytes, list] = {}
        for i, p in block:
            ids.setdefault(p.encode(), []).append(i)
        self.items = list(ids.items())
        self.tables = []
        for m in _HEADS:
            longer = min((h for h in _HEADS if h > m), default=1 << 62)
            own = [k for k, (p, _) in enumerate(self.items) if m <= len(p) < longer]
            if own:
                keys = np.array([_heads(np.frombuffer(self.items[k][0][:m], dtype=np.uint8), m)[0] for k in own], dtype=np.uint64)
                order = np.argsort(keys, kind="stable")
                near = np.zeros(1 << _BITS, dtype=bool)
                near[self._slot(keys)] = True
                self.tables.append((m, keys[order], np.array(own)[order], near))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def within(self, texts: list[bytes]):
        """(number of the text, item) of each passage that stands in a text, once a pair."""
        whole = _NOT_TEXT.join(texts)
        data = np.frombuffer(whole, dtype=np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        found = set()
        for m, keys, numbers, near in self.tables:
            if len(data) < m:
                continue
            heads = _heads(data, m)
            places = np.flatnonzero(near[self._slot(heads)])
            low, high = np.searchsorted(keys, heads[places]), np.searchsorted(keys, heads[places], side="right")
            real = high > low
            rows = np.searchsorted(starts, places[real], side="right") - 1
            for at, a, b, row in zip(places[real].tolist(), low[real].tolist(), high[real].tolist(), rows.tolist()):
                found.update((row, k) for k in numbers[a:b].tolist() if (row, k) not in found and whole.startswith(self.items[k][0], at))
        return [(row, i) for row, k in sorted(found) for i in dict.fromkeys(self.items[k][1])]
