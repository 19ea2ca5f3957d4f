"""Vectorised text batches for the Python-side operators of this subpackage.

An Arrow batch of texts is looked at as one flat array of UTF-8 bytes with row offsets. Words,
lines and shingles are then found and hashed with array operations over the whole batch instead of
a Python loop over words. Hashes are 64 bits wide; whatever decides a result on them says so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_CACHE: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _seeded(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers r**i and r**-i modulo 2**64 for an odd r; grown on demand and kept per process."""
    have = _CACHE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        r = 0x5851F42D4C957F2D
        inverse = pow(r, -1, 1 << 64)
        out = []
        for base in (r, inverse):
            p = np.ones(size, dtype=np.uint64)
            done, step = 1, base
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(step)
                step = step * step % (1 << 64)
                done *= 2
            out.append(p)
        _CACHE["powers"] = have = (out[0], out[1])
    return have


class Texts:
    """One batch of texts: `data` (uint8), row starts and ends. Null rows count as empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if offsets else np.zeros(n + 1, dtype=np.int64)
        flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, dtype=np.uint8)
        self.n, self.data = n, flat
        self.starts, self.ends = off[:-1] - off[0], off[1:] - off[0]
        self.null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, dtype=bool)

    def text(self, row: int) -> bytes:
        return self.data[self.starts[row] : self.ends[row]].tobytes()

    def lowered(self) -> Texts:
        """The same batch with A-Z in lower case (other letters stay)."""
        out = Texts.__new__(Texts)
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        out.__dict__.update(self.__dict__)
        out.data = table[self.data]
        return out

    def chars(self) -> np.ndarray:
        """Code points of each row."""
        return self.count(np.fromiter(((b & 0xC0) != 0x80 for b in range(256)), dtype=bool))

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Bytes of each row that `wanted`, a table of 256 booleans, marks."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(wanted[self.data], out=total[1:])
        return total[self.ends] - total[self.starts]


class Spans:
    """Maximal runs of the bytes outside `delimiters`, in row order: row, start and end in bytes."""

    def __init__(self, texts: Texts, delimiters):
        table = np.zeros(256, dtype=bool)
        table[list(delimiters)] = True
        inside = np.zeros(len(texts.data) + 2, dtype=np.int8)
        inside[1:-1] = ~table[texts.data]
        edge = np.flatnonzero(np.diff(inside))
        starts, ends = edge[::2], edge[1::2]
        # A run that goes on into the next row is cut at the row's start.
        cut = texts.starts[1:]
        cut = cut[(cut > 0) & (cut < len(texts.data))]
        if len(cut):
            cut = np.unique(cut)
            k = np.searchsorted(starts, cut, side="right") - 1
            hit = (k >= 0) & (starts[np.maximum(k, 0)] < cut) & (cut < ends[np.maximum(k, 0)])
            extra = cut[hit]
            if len(extra):
                starts = np.sort(np.concatenate([starts, extra]))
                ends = np.sort(np.concatenate([ends, extra]))
        self.texts, self.starts, self.ends = texts, starts, ends
        # Rows that hold bytes have strictly increasing starts; empty rows own no run.
        full = np.flatnonzero(texts.ends > texts.starts)
        self.row = full[np.searchsorted(texts.starts[full], starts, side="right") - 1] if len(full) else np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.row, np.arange(texts.n), side="left")
        self.last = np.searchsorted(self.row, np.arange(texts.n), side="right")

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.texts.data, self.starts, self.ends)

    def per_row(self) -> np.ndarray:
        return self.last - self.first


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    power, inverse = _powers(len(data) + 1)
    if "bytes" not in _CACHE:
        _CACHE["bytes"] = _seeded(7, 256)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CACHE["bytes"][data] * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Bytes up to which a span is hashed beside all others; longer ones are hashed one by one.
_SHORT_SPAN = 64


def chained_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, in blocks of 8 that are mixed in one after another.

    Slower than hash_spans, whose sums of powers have known collisions (of texts of 1024 bytes and more); for what
    is decided by hashes alone.
    """
    sizes = (ends - starts).astype(np.int64)
    out = mix64(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    blocks = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= _SHORT_SPAN))
    at = 0
    while len(live):
        left = sizes[live] - at
        block = blocks[starts[live] + at].astype(np.uint64)
        block &= np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        out[live] = mix64(out[live] ^ block) + np.uint64(at + 1)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > _SHORT_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(spans: Spans, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (its index) and hash of each run of `k` consecutive words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(spans.row[:n] == spans.row[k - 1 :])
    return first, sequence_hash(hashes, k)[first]


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of `k` consecutive values, rows disregarded; depends on their order."""
    n = len(hashes)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    return mix64((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1] + np.uint64(k))


def row_slices(sizes: np.ndarray, limit: int):
    """Cuts rows into runs (a, b) of at most `limit` bytes each, one row at least."""
    a, used = 0, 0
    for i, s in enumerate(sizes):
        if used and used + s > limit:
            yield a, i
            a, used = i, 0
        used += int(s)
    if a < len(sizes):
        yield a, len(sizes)


def bounded(batches, column: str = "text", limit: int = 2 << 20):
    """Arrow batches cut so that one holds at most `limit` bytes of `column`, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        for a, b in row_slices(sizes, limit):
            yield batch.slice(a, b - a)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
