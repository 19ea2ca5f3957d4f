"""Interpolated character n-gram models of several classes, kept in sorted hash arrays.

An n-gram's hash finds its row in one sorted array of an order; the row holds, for each class, the
discounted share of the n-gram in its context. A second array of contexts holds the mass left for the
shorter order. P_n = share + left * P_(n-1), down to a uniform floor. Kneser-Ney and Witten-Bell differ
only in how shares and left-over mass are made from counts.
"""

from __future__ import annotations

import numpy as np

from ._batch import mix64

CHUNK = 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two edges, and where each text's first edge stands."""
    joined = " " + "  ".join(texts) + " " if texts else ""
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _contexts(flat: np.ndarray, starts: np.ndarray, order: int):
    """For each predicted position (all but first edges), hashes of the contexts of 0..order-1
    characters and the n-grams that end there; contexts stop at the text's first edge."""
    sizes = np.diff(starts)
    depth = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    at = np.flatnonzero(depth > 0)
    depth = depth[at]
    code = mix64(flat.astype(np.uint64) + np.uint64(1))
    context = np.full(len(at), np.uint64(0x51), dtype=np.uint64)
    for n in range(1, order + 1):
        gram = mix64(context * _STEP + code[at] + np.uint64(0xABCD))
        yield n, at, depth, context, gram
        # The context grows to the left; a position with no more history keeps its context.
        prior = np.maximum(at - n, 0)
        context = np.where(depth >= n, mix64(context * _STEP + code[prior]), context)


class _Sorted:
    """A sorted array of hashes with the place where each run of equal leading bits begins, so that a search
    takes a step or two in place of one for each doubling of the array."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, min(24, int(self.n).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each wanted hash, and whether it is there."""
        at = self.begin[wanted >> self.shift]
        low = np.flatnonzero(self.keys[at] < wanted)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < wanted[low]]
        return at, (self.keys[at] == wanted) & (at < self.n)


class CharModels:
    """Models of K classes over the same texts' alphabet."""

    def __init__(self, classes: list[str], order: int, kind: str = "kneser-ney", discount: float = 0.75, alphabet: int = 512):
        self.classes, self.order, self.kind, self.discount, self.floor = classes, order, kind, discount, 1.0 / alphabet
        self.tables: list[tuple] = []

    def fit(self, samples: list[tuple[list[str], np.ndarray]]) -> CharModels:
        """samples: for each class, distinct texts and how often each stands in the class."""
        grams: list[list[tuple]] = [[] for _ in range(self.order + 1)]
        for texts, counts in samples:
            flat, starts = points(texts)
            weight = np.repeat(np.asarray(counts, dtype=np.float64), np.diff(starts))
            for n, at, depth, context, gram in _contexts(flat, starts, self.order):
                own = depth >= n - 1 if n > 1 else np.ones(len(at), dtype=bool)
                keys, first, back = np.unique(gram[own], return_index=True, return_inverse=True)
                grams[n].append((keys, context[own][first], np.bincount(back, weights=weight[at[own]], minlength=len(keys))))
        # What a context of n-1 characters is to the n-gram one longer: needed for continuation counts.
        suffix: list[list[tuple]] = [[] for _ in range(self.order + 2)]
        for texts, _ in samples:
            flat, starts = points(texts)
            before = None
            for n, at, depth, _, gram in _contexts(flat, starts, self.order):
                if before is not None:
                    own = depth >= n - 1
                    _, first = np.unique(gram[own], return_index=True)
                    short, times = np.unique(before[own][first], return_counts=True)
                    suffix[n - 1].append((short, times.astype(np.float64)))
                before = gram
        for n in range(1, self.order + 1):
            keys = np.unique(np.concatenate([g[0] for g in grams[n]]))
            heads = np.unique(np.concatenate([g[1] for g in grams[n]]))
            share = np.zeros((len(keys), len(samples)), dtype=np.float32)
            left = np.ones((len(heads), len(samples)), dtype=np.float32)
            for k, (own, context, count) in enumerate(grams[n]):
                if self.kind == "kneser-ney" and n < self.order:
                    # Kneser-Ney counts below the top: in how many longer n-grams it ends. Those that
                    # begin at the first edge have no longer form and keep their own count.
                    short, times = suffix[n][k]
                    i = np.minimum(np.searchsorted(short, own), len(short) - 1)
                    count = np.where(short[i] == own, times[i], count)
                head = np.searchsorted(heads, context)
                total = np.bincount(head, weights=count, minlength=len(heads))
                kinds = np.bincount(head, minlength=len(heads))
                if self.kind == "kneser-ney":
                    value = np.maximum(count - self.discount, 0.0) / total[head]
                    rest = np.where(total > 0, self.discount * kinds / np.maximum(total, 1e-9), 1.0)
                else:
                    value = count / (total + kinds)[head]
                    rest = np.where(total > 0, kinds / np.maximum(total + kinds, 1e-9), 1.0)
                share[np.searchsorted(keys, own), k] = value
                left[:, k] = np.minimum(rest, 1.0)
            ends = np.zeros((1, len(samples)), dtype=np.float32)
            self.tables.append((_Sorted(keys), np.concatenate([share, ends]), _Sorted(heads), np.concatenate([left, ends + 1])))
        return self

    def log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each text (with its last edge) in each class, and its number of
        predicted characters."""
        k = len(self.classes)
        if not texts:
            return np.zeros((0, k)), np.zeros(0, dtype=np.int64)
        size = np.cumsum([len(t) + 2 for t in texts])
        if size[-1] > CHUNK and len(texts) > 1:  # a bounded number of characters at a time
            parts, a = [], 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, side="right")))
                parts.append(self.log_probs(texts[a:b]))
                a = b
            return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        flat, starts = points(texts)
        p = None
        for (keys, share, heads, left), (n, at, depth, context, gram) in zip(self.tables, _contexts(flat, starts, self.order)):
            if p is None:
                p = np.full((len(at), k), self.floor, dtype=np.float32)
            i, known = heads.find(context)
            j, seen = keys.find(gram)
            known &= depth >= n - 1
            # The last rows stand for contexts and n-grams that aren't there.
            p *= left.take(np.where(known, i, len(left) - 1), axis=0)
            p += share.take(np.where(seen & known, j, len(share) - 1), axis=0)
        sizes = np.diff(starts) - 1
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(np.log(p, dtype=np.float64), first, axis=0), sizes
