"""Logistic mixing of bit predictors over symbols in a prefix code.

A symbol (a word, or a byte of a word) is a path of bits in a canonical Huffman code of the symbols' counts, so
that a symbol takes as many binary decisions as its share is worth. Every decision is a node of
the code's tree. Predictors are counts of what followed at a node: under no context (exact), under hashed
contexts, and within the text itself. Their stretched probabilities are combined by weights that a gate
chooses, and a probability map refines the mix.

All positions of a chunk go through the tree level by level as arrays, longest codes first, so that those with
a bit at a level are a slice. A text's own past grows by segments, each as long as all before it: the positions
of one segment, of all texts of the chunk, see the bits of the segments before, and then theirs are added.
"""

from __future__ import annotations

from collections import deque

import numpy as np

LIMIT = np.float32(8)
BINS = 65
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


class Code:
    """A canonical Huffman code: for each symbol its bits from the left of 32, and how many there are."""

    def __init__(self, counts: np.ndarray):
        # Very rare symbols count a little more, which keeps codes below 32 bits.
        counts = np.maximum(np.asarray(counts, dtype=np.int64), max(1, int(counts.sum()) >> 20))
        order = np.argsort(counts, kind="stable")
        self.length = np.zeros(len(counts), dtype=np.uint8)
        self.length[order] = _lengths(counts[order].tolist())
        by = np.argsort(self.length, kind="stable")
        deepest = int(self.length.max(initial=0))
        here = np.bincount(self.length, minlength=deepest + 1)
        #: By depth: the first prefix that is no leaf, and the number of nodes above.
        self.inner, self.above = np.zeros(deepest + 1, dtype=np.int64), np.zeros(deepest + 1, dtype=np.int64)
        prefix, first = 0, np.zeros(deepest + 1, dtype=np.int64)
        nodes = 0
        for d in range(deepest + 1):
            first[d], self.above[d] = prefix, nodes
            self.inner[d] = prefix + here[d]
            nodes += (1 << d) - int(self.inner[d]) if d < deepest else 0
            prefix = int(self.inner[d]) * 2
        self.nodes = max(nodes, 1)
        rank = np.arange(len(by)) - np.concatenate([[0], np.cumsum(here)])[self.length[by]]
        self.left = np.zeros(len(counts), dtype=np.uint32)
        self.left[by] = ((first[self.length[by]] + rank) << (32 - self.length[by].astype(np.int64))).astype(np.uint64).astype(np.uint32)
        self.deepest = deepest

    def at(self, depth: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of some codes at a depth, and their bits there."""
        bit = (left >> np.uint32(31 - depth)) & np.uint32(1)
        # At depth 0 the shift by 32 would be no shift.
        prefix = left >> np.uint32(32 - depth) if depth else np.zeros(len(left), dtype=np.uint32)
        return prefix + np.uint32((int(self.above[depth]) - int(self.inner[depth])) % (1 << 32)), bit

    def exact(self, counts: np.ndarray) -> np.ndarray:
        """Counts of bits 0 and 1 at each node."""
        out = np.zeros((2, self.nodes))
        for d in range(self.deepest):
            own = np.flatnonzero(self.length > d)
            node, bit = self.at(d, self.left[own])
            for b in (0, 1):
                out[b] += np.bincount(node[bit == b], weights=counts[own[bit == b]], minlength=self.nodes)
        return out


def _lengths(counts: list[int]) -> list[int]:
    """Code lengths of symbols by rising counts: the two-queue form of Huffman's algorithm."""
    n = len(counts)
    if n < 2:
        return [1] * n
    weight, parent = counts + [0] * (n - 1), [0] * (2 * n - 1)
    inner: deque[int] = deque()
    leaf = 0
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if inner and (leaf == n or weight[inner[0]] < weight[leaf]):
                k = inner.popleft()
            else:
                k, leaf = leaf, leaf + 1
            parent[k] = new
            total += weight[k]
        weight[new] = total
        inner.append(new)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), -LIMIT, LIMIT).astype(np.float32, copy=False)


def _slots(context: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    """Slots of nodes (times _A) under contexts in a table of 2**bits."""
    s = context + hashed
    s *= _B
    s >>= np.uint32(32 - bits)
    return s


#: ln(n + 0.4) of small counts.
_LOGS = np.log(np.arange(4096) + 0.4).astype(np.float32)
_FEW = np.digitize(np.arange(17), (1, 3, 16)).astype(np.intp)
DEPTHS = np.digitize(np.arange(40), (2, 5, 9, 13)).tolist()
#: The first segment of a text.
FIRST = 16
#: Positions that go through a level at a time.
STRIP = 1 << 15
#: Slots of a text's own past, for each of its positions.
ROOM = 8


def room_bits(positions: np.ndarray) -> np.ndarray:
    """Slots for the past of texts of so many positions, as powers of 2."""
    return np.ceil(np.log2(np.maximum(positions, 1) * ROOM)).astype(np.int64).clip(4, 30)


def room_slot(node: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The slot of a node among the 2 ** (32 - shift) of a text."""
    return _room_slot(node * _A, shift)


def _room_slot(hashed: np.ndarray, shift: np.ndarray) -> np.ndarray:
    h = hashed >> np.uint32(15)
    h ^= hashed
    h *= _B
    h >>= shift
    return h


class Chunk:
    """Positions of whole texts: symbols' codes and hashed contexts, ordered by segment and falling length.

    text, step: the number of each position's text and its place in it. Each text's past has slots of its own, by its
    length, so that nothing depends on the texts beside it. guess: the code that the text's own past
    foretells, and trust: 0 without a guess, 1 to 3 by how many guesses came true just before. Symbols without a
    past (the bytes of words) have a place in the word instead.
    """

    def __init__(self, code: Code, left, length, contexts, text=None, step=None, guess=None, trust=None, place=None):
        self.code, self.past, n = code, text is not None, len(left)
        segment = np.zeros(n, dtype=np.int16)
        if self.past:
            segment = _segment(step)
        self.order = np.argsort(segment * np.int16(64) - length, kind="stable")
        pick = lambda x: None if x is None else x.take(self.order, mode="clip")
        self.left, self.length, self.contexts = pick(left), pick(length), [pick(c) for c in contexts]
        #: In steps of the gate, as is trust.
        self.place = pick(None if place is None else place.astype(np.intp) * 4)
        if self.past:
            many = np.bincount(text)
            bits = room_bits(many) if n else np.zeros(0, dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(1 << bits)])
            self.room = int(first[-1])
            self.shift, self.base = pick((32 - bits).astype(np.uint32).take(text)), pick(first[:-1].astype(np.intp).take(text))
            #: Positions that later segments of their text look back at.
            self.kept = pick(segment < _segment(many - 1).take(text))
            self.trust = pick(trust.astype(np.intp) * 4)
            # How many bits the guess shares with the symbol from the left; -1 without a guess.
            self.shared = pick(np.where(trust > 0, 32 - np.frexp((guess ^ left).astype(np.float64))[1], -1).astype(np.int8))
        self.bounds = np.searchsorted(segment.take(self.order), np.arange(int(segment.max(initial=-1)) + 2)).tolist()

    def levels(self):
        """For each segment, strip of it and depth: the slice of positions that have a bit there, their nodes and bits."""
        for a, end in zip(self.bounds, self.bounds[1:]):
            for start in range(a, end, STRIP):
                live = min(STRIP, end - start)
                sizes = np.bincount(self.length[start : start + live])
                for d in range(len(sizes) - 1):
                    live -= int(sizes[d])
                    own = slice(start, start + live)
                    node, bit = self.code.at(d, self.left[own])
                    yield a, d, own, node, bit


def _segment(step: np.ndarray) -> np.ndarray:
    return (np.log2(np.maximum(step, 1) / (FIRST / 2)).clip(0)).astype(np.int16)


class Tables:
    """Counts of bits: exact by node, and by slot for each hashed context; settled, their stretched shares."""

    def __init__(self, exact: np.ndarray, hashed: list[np.ndarray], bits):
        self.counts = [exact.astype(np.float32), *hashed]  # each (2, nodes) or (2, 2**bits)
        self.bits, self.ready = bits, None

    def settle(self) -> None:
        self.ready = [stretch(*c) for c in self.counts]
        self.counts = None

    def inputs(self, chunk: Chunk, own: slice, node, hashed, bit, rows: np.ndarray) -> None:
        """Fills rows with stretched probabilities of each predictor; until settled, with each bit left out of its own counts."""
        places = (node if k < 0 else _slots(chunk.contexts[k][own], hashed, self.bits[k]) for k in range(-1, len(self.bits)))
        if self.ready:
            for row, t, s in zip(rows, self.ready, places):
                t.take(s, mode="clip", out=row)
            return
        one = bit.astype(np.float32)
        zero = np.float32(1) - one
        for row, c, s in zip(rows, self.counts, places):
            s = s.astype(np.intp)
            row[:] = stretch(np.maximum(c[0].take(s, mode="clip") - zero, 0), np.maximum(c[1].take(s, mode="clip") - one, 0))


def count(chunk: Chunk, bits, sums: list[np.ndarray]) -> None:
    """Counts every bit in one vector for each context, at twice the slot plus the bit."""
    for _, _, own, node, bit in chunk.levels():
        node *= _A
        for c, b, into in zip(chunk.contexts, bits, sums):
            s = _slots(c[own], node, b)
            s <<= np.uint32(1)
            s |= bit
            np.add.at(into, s.astype(np.intp), 1)


class Mixer:
    """Gated weights and a probability map; learns both from chunks, online."""

    def __init__(self, inputs: int, past: bool):
        self.n = inputs + (2 if past else 0) + 1
        self.wide = 16 if past else 12
        self.gates = 5 * self.wide
        self.weights = np.zeros((self.n, self.gates), dtype=np.float32)
        self.weights[: self.n - 1] = 0.3
        self.curve = np.tile(np.eye(self.n) * 30.0, (self.gates, 1, 1))
        self.start = np.tile(1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) / 4)), self.gates)
        self.seen = np.zeros((self.gates * BINS, 2), dtype=np.int64)  # by cell, bits 0 and 1
        self.map = self.start.astype(np.float32)

    def _rows(self, tables: Tables, chunk: Chunk):
        """For each level and strip: segment, depth, slice of positions, bits, inputs with a row of ones, and gates
        from the level's first on."""
        table = np.zeros(2 * chunk.room, dtype=np.int32) if chunk.past else None
        base, met, one = -1, [], np.int32(1)
        for a, d, own, node, bit in chunk.levels():
            hashed = node * _A
            rows = np.empty((self.n, len(bit)), dtype=np.float32)
            rows[-1] = 1
            tables.inputs(chunk, own, node, hashed, bit, rows)
            if not chunk.past:
                known = (rows[1] != 0).view(np.int8)
                for v in rows[2:-1]:
                    known += v != 0
                gate = np.minimum(known, 3, out=known).astype(np.intp)
                gate += chunk.place[own]
                yield a, d, own, bit, rows, gate
                continue
            if a != base:  # a new segment: the one before is past now
                for s in met:
                    np.add.at(table, s, one)
                base, met = a, []
            slot = _room_slot(hashed, chunk.shift[own]).astype(np.intp)
            slot += chunk.base[own]
            if a:
                # Both counts of a slot are read as one.
                ones = table.view(np.int64).take(slot, mode="clip")
                zeros = ones & 0xFFFFFFFF
                ones >>= 32
                _LOGS.take(ones, mode="clip", out=rows[-3])
                rows[-3] -= _LOGS.take(zeros, mode="clip")
                zeros += ones
                gate = _FEW.take(zeros, mode="clip")
            else:
                rows[-3] = 0
                gate = np.zeros(len(bit), dtype=np.intp)
            slot <<= 1
            slot |= bit
            met.append(slot.compress(chunk.kept[own]))
            # Where the guess has held up to here, it holds at this bit too or fails now.
            shared = chunk.shared[own]
            told = np.flatnonzero(shared >= d)
            sign = bit.take(told).astype(np.float32)
            sign *= 2
            sign -= 1
            np.negative(sign, out=sign, where=shared.take(told) == d)
            rows[-2] = 0
            rows[-2][told] = sign
            gate[told] += chunk.trust[own].take(told)
            yield a, d, own, bit, rows, gate

    def _mixed(self, weights, rows, gate):
        """The mix, stretched, as a probability, and the cells of the map."""
        parts = weights.take(gate, axis=1, mode="clip")
        parts *= rows
        dot = parts.sum(axis=0)
        np.clip(dot, -12, 12, out=dot)
        p = np.exp(-dot)
        p += 1
        np.reciprocal(p, out=p)
        cell = dot * np.float32(4)
        cell += np.float32(BINS // 2 + 0.5)
        np.clip(cell, 0, BINS - 1, out=cell)
        cell = cell.astype(np.intp)
        cell += gate * BINS
        return dot, p, cell

    def log2(self, tables: Tables, chunk: Chunk) -> np.ndarray:
        """log2 probability of each position's symbol."""
        out = np.ones(len(chunk.left))
        for _, d, own, bit, rows, gate in self._rows(tables, chunk):
            first = self.wide * DEPTHS[d]
            _, p, cell = self._mixed(self.weights[:, first : first + self.wide], rows, gate)
            # At most 32 factors of at least 1 / 65536.
            out[own] *= self._coded(p, self.map[first * BINS : (first + self.wide) * BINS].take(cell, mode="clip"), bit)
        return self._ordered(chunk, np.log2(out))

    def _coded(self, p, q, bit):
        q += p
        q *= np.float32(0.5)
        np.clip(q, np.float32(1 / 65536), np.float32(1 - 1 / 65536), out=q)
        # The bit's own share: q for 1, 1 - q for 0.
        one = bit.astype(np.float32)
        one -= 1
        q += one
        return np.abs(q, out=q)

    def _ordered(self, chunk, out):
        back = np.empty_like(out)
        back[chunk.order] = out
        return back

    def learn(self, tables: Tables, chunk: Chunk) -> None:
        """One step on a chunk: the gradients and curvatures of its bits, and the cells that they fall in."""
        push, bend, wide = np.zeros((self.n, self.gates)), np.zeros((self.gates, self.n, self.n)), self.wide
        each = np.arange(wide, dtype=np.int8)[:, None]
        whole: dict[tuple[int, int], list] = {}
        for a, d, own, bit, rows, gate in self._rows(tables, chunk):
            first = wide * DEPTHS[d]
            dot, p, cell = self._mixed(self.weights[:, first : first + wide], rows, gate)
            wrong = bit.astype(np.float32)
            wrong -= p
            # Above the bound of Jaakkola and Jordan, tanh(x / 2) / 2x, in place of p (1 - p): no step makes a gate worse.
            curve = np.abs(dot, out=dot)
            curve *= np.float32(0.5)
            curve += np.float32(4)
            np.reciprocal(curve, out=curve)
            cell <<= 1
            cell |= bit
            self.seen[first * BINS : (first + wide) * BINS] += np.bincount(cell, minlength=2 * wide * BINS).reshape(-1, 2)
            bent = (rows * curve) @ rows.T
            rows *= wrong
            # The gates of a level are few: sums by gate are a product with a row of marks for each.
            marks = (gate.astype(np.int8) == each).astype(np.float32)
            push[:, first : first + wide] += rows @ marks.T
            level = whole.setdefault((a, d), [0, 0])
            level[0], level[1] = level[0] + (marks @ curve).astype(np.float64), level[1] + bent
        # One curvature for a level, dealt to its gates by their share.
        for (_, d), (mass, bent) in whole.items():
            first = wide * DEPTHS[d]
            bend[first : first + wide] += (mass / max(mass.sum(), 1e-9))[:, None, None] * bent
        self.curve += bend
        self.weights += np.linalg.solve(self.curve, push.T[:, :, None])[:, :, 0].T.astype(np.float32)

    def sums(self) -> np.ndarray:
        """What adds up over tasks: curvatures, weights times curvatures, and the map's cells."""
        both = self.curve @ self.weights.T.astype(np.float64)[:, :, None]
        return np.concatenate([self.curve.reshape(-1), both.reshape(-1), self.seen.reshape(-1)])

    def settle(self, sums: np.ndarray) -> int:
        """Takes the mean of all tasks' weights, weighed by curvature, and the cells of them all; how many bits
        those have seen."""
        a, b = self.gates * self.n * self.n, self.gates * self.n
        curve = sums[:a].reshape(self.gates, self.n, self.n)
        if curve.any():
            self.weights = np.linalg.solve(curve, sums[a : a + b].reshape(self.gates, self.n, 1))[:, :, 0].T.astype(np.float32)
        seen = sums[a + b :].reshape(-1, 2)
        self.map = ((50 * self.start + seen[:, 1]) / (50 + seen.sum(axis=1))).astype(np.float32)
        self.curve = self.seen = None
        return int(round(seen.sum()))
