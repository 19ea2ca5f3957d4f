"""Language-model scoring by logistic context mixing over bits.

A text is a sequence of words and one end. Each is coded by binary decisions (`_mixing.py`): frequent words and
the end are symbols of a prefix code, other words are one further symbol and are spelled byte by byte, each
byte by the decisions of a second code. For every decision these predictors are mixed by gated weights:

* counts at the node of the code, under no context;
* counts under hashed contexts of the words before: how the last word ended, and which of the most frequent words
  the text has used most so far, with the last word's last byte;
* counts at the node within the text so far, and the word that followed the last word when it last stood in
  the text. These follow the text as it is read, word by word;
* in spelled words, counts under hashed contexts of the 1, 2, 3 and 5 bytes before.

The gate is the depth in the code, how often the text has passed the node, and how many of its own guesses
came true just before (in spelled words: depth, place in the word, known contexts). A probability map by gate
refines the mix. A word outside the code that the text has spelled before is one decision and its share of
those. The score is the sum over all decisions; over the bytes it is the bits-a-byte figure.

What is learned, and from where: words are counted by a shuffle, and everything else is summed over all
training texts: bits by slot (dense blocks of slots, added up by a shuffle, for two halves of the texts apart), then weights
and map, online, the texts of each half by the counts of the other. Texts are dealt into shards by a hash of id and text, as many as the counted words ask for, and read
in order of that hash, in runs cut by size; each shard learns from the start, and the shards' weights are averaged by curvature. So the
model depends on the rows alone, not on how a table or a job is partitioned. Spelling is learned in the same way from every
distinct word outside the code. A text's score depends on the model and on the text alone: its past has slots of its own.

The code holds at most `head_words` words (broadcast); their counts and all others' serve the base score, the
latter through a shuffle join, so the vocabulary may grow without limit. Tables have fixed numbers of slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import SPACE, Spans, Texts, bounded, mix64
from ._charlm import _Sorted
from ._mixing import Chunk, Code, Mixer, Tables, count
from ._session import BATCH_BYTES, quoted, ship, table, written
from .language_id import fold

HEAD_WORDS = 1 << 19
#: Slots of the hashed contexts, as powers of 2: of words, and of bytes.
WORD_BITS = (20, 21)
BYTE_BITS = (16, 20, 20, 20)
TOPICS = 16
#: Bytes of text that go through the code at a time.
READ_BYTES = 1 << 20
#: Tokens of a shard of texts, and words of a shard of spelled words, that one learner reads.
SHARD_TOKENS, SHARD_WORDS = 1 << 20, 1 << 18
_BLOCK = 1 << 14
_UNIT = 1 << 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_END, _OTHER = 0, 1
#: Names of blocks: what stands beside the contexts, and the bit that tells the halves apart.
_SYMBOLS, _HALF = 9, 48
_CLOSE = 256


def _short(x: np.ndarray) -> np.ndarray:
    return (mix64(x) >> np.uint64(32)).astype(np.uint32)


class Vocabulary:
    """Frequent words by sorted hashes, with their code: symbol 0 ends a text, 1 is any other word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, others: int):
        self.index, self.counts, self.ends = _Sorted(keys), counts, ends
        self.symbols = np.concatenate([[max(ends, 1), max(others, 1)], counts]).astype(np.int64)
        self.code = Code(self.symbols)
        self.topic = np.full(len(self.symbols), -1, dtype=np.int8)
        top = np.argsort(-counts, kind="stable")[:TOPICS] + 2
        self.topic[top] = np.arange(len(top))


class Positions:
    """The words and ends of some texts in order, with what the contexts and the text's past give."""

    def __init__(self, own: Vocabulary, texts: Texts, past: bool = True):
        """Without a past there is nothing to foretell, which will do to count."""
        words = Spans(texts, SPACE)
        self.words, self.hashes = words, words.hashes()
        at, self.known = own.index.find(self.hashes)
        n = len(words) + texts.n
        self.place = np.arange(len(words)) + words.row  # a word stands behind the ends of the texts before
        ends = words.last + np.arange(texts.n)
        self.symbol = np.zeros(n, dtype=np.int32)
        self.symbol[self.place] = np.where(self.known, at + 2, _OTHER)
        self.row = np.empty(n, dtype=np.int64)
        self.row[self.place], self.row[ends] = words.row, np.arange(texts.n)
        first = (words.first + np.arange(texts.n))[self.row]
        opening = np.arange(n) == first

        def before(values, start):
            out = np.full(n, start, dtype=values.dtype)
            out[self.place] = values
            out[1:] = out[:-1].copy()
            out[opening] = start
            return out

        data, a, b = texts.data, words.starts, words.ends
        last = data[b - 1].astype(np.uint64) if len(words) else np.zeros(0, dtype=np.uint64)
        tail = last + np.where(b - a > 1, data[np.maximum(b - 2, a)].astype(np.uint64) + np.uint64(1), np.uint64(0)) * np.uint64(256) if len(words) else last
        most = _most(own.topic[self.symbol], self.row).astype(np.uint64)
        contexts = [_short(before(tail, 1 << 20)), _short((most << np.uint64(32)) + before(last, 1 << 10) + _STEP)]
        self.chunk = Chunk(own.code, own.code.left[self.symbol], own.code.length[self.symbol], contexts, *(self._past(own.code, before(self.hashes, 0), opening, first) if past else ()))
        # Words outside the code: how often the text has spelled each, and how many in all, before.
        self.other = np.flatnonzero(~self.known)
        row = words.row[self.other]
        self.times, self.spelled = _times(row, self.hashes[self.other])

    def _past(self, code: Code, prior: np.ndarray, opening: np.ndarray, first: np.ndarray):
        """The text and the place in it, the code of what followed the last word when the text had it last, and
        how far to trust that."""
        n = len(prior)
        order, same = _alike(mix64(prior + self.row.astype(np.uint64) * _STEP))
        source = np.full(n, -1, dtype=np.int64)
        source[order[same]] = order[np.flatnonzero(same) - 1]
        there = source >= 0
        symbol = self.symbol[np.maximum(source, 0)]
        # How many guesses in a row came true up to here; the text's first position starts anew.
        true = there & (symbol == self.symbol)
        here = np.arange(n)
        miss = np.maximum.accumulate(np.where(true & ~opening, -1, here)) if n else here
        streak = np.concatenate([[0], (here - miss)[:-1]]) if n else here
        streak[opening] = 0
        return self.row, here - first, code.left[symbol], np.where(there, 1 + (streak > 0) + (streak > 3), 0).astype(np.uint32)


def _alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions by key, those of a key in order; and whether each has the key of the one before."""
    n = len(key)
    low = np.uint64((1 << n.bit_length()) - 1)
    # Keys whose last bits give way to the position sort faster than with places beside them.
    short = np.sort((key & ~low) | np.arange(n, dtype=np.uint64))
    order = (short & low).astype(np.int64)
    same = np.concatenate([[False], (short[1:] ^ short[:-1]) <= low]) if n else np.zeros(0, dtype=bool)
    whole = key.take(order)
    if (whole[1:] != whole[:-1])[same[1:]].any():  # two keys differ in the last bits alone
        order = np.argsort(key, kind="stable")
        whole = key.take(order)
        same = np.concatenate([[False], whole[1:] == whole[:-1]])
    return order, same


def _most(topic: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each position the topic that its row has had most so far, the first of equals; TOPICS before any."""
    hit = np.flatnonzero(topic >= 0)
    kind, of = topic[hit], row[hit]
    order = np.argsort(kind, kind="stable")
    k, r = kind[order], of[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])[: len(hit)]
    here = np.arange(len(hit))
    times = np.empty(len(hit), dtype=np.int64)
    times[order] = here - np.maximum.accumulate(np.where(new, here, 0)) + 1
    # A topic's count only grows, so the most used so far is the largest count at any hit. Of equals the first is the larger value.
    best = np.append(row << 32, 0)
    best[hit + 1] = np.maximum(best[hit + 1], (of << 32) + times * TOPICS + (TOPICS - 1 - kind))
    best = np.maximum.accumulate(best)[:-1] & 0xFFFFFFFF
    return np.where(best >= TOPICS, TOPICS - 1 - best % TOPICS, TOPICS)


def _times(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: how often it stood in its row before, and how many words did."""
    n = len(row)
    order, same = _alike(mix64(h + row.astype(np.uint64) * _STEP))
    start = ~same
    begin = np.maximum.accumulate(np.where(start, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
    before = np.zeros(n, dtype=np.int64)
    before[order] = np.arange(n) - begin
    first = np.searchsorted(row, row, side="left") if n else np.zeros(0, dtype=np.int64)
    return before, np.arange(n) - first


def _buckets(seen: np.ndarray) -> np.ndarray:
    return np.digitize(seen, (1, 2, 4, 8, 16, 64))


def _reads(own: Vocabulary, batches, past: bool = True):
    """Positions of runs of whole texts, READ_BYTES at a time or one text."""
    for batch in bounded(batches, "text", READ_BYTES):
        yield Positions(own, Texts(batch.column("text")).lowered(), past)


def _dealt(rows: DataFrame, key: str, column: str, shards: int) -> DataFrame:
    """Shard (even for a half 0, odd for a half 1) and text in order: the same for the same rows, however they are
    partitioned."""
    shard = F.pmod(F.col(key), F.lit(shards)).cast("int") * 2
    named = rows.select((shard + F.col("half") if "half" in rows.columns else shard).alias("shard"), key, column)
    return named.repartition("shard").sortWithinPartitions("shard", key, column).select("shard", column)


def _runs(batches, column: str, limit: int):
    """(shard, its next texts) in order, cut by shard and by size, whatever the batches."""
    part, used, now = [], 0, None
    for batch in batches:
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column(column).to_pylist()):
            if part and (shard != now or used + len(text) > limit):
                yield now, part
                part, used = [], 0
            part.append(text)
            used += len(text)
            now = shard
    if part:
        yield now, part


def _learned(runs, fresh, learn) -> np.ndarray:
    """Sum over shards of what a mixer made by fresh() holds after learn(mixer, texts, shard) of the shard's runs, in whole
    multiples of 1 / _UNIT."""
    total, now, mixer = np.rint(fresh().sums() * 0), None, None
    for shard, texts in runs:
        if shard != now:
            if mixer is not None:
                total += np.rint(mixer.sums() * _UNIT)
            now, mixer = shard, fresh()
        learn(mixer, texts, shard)
    if mixer is not None:
        total += np.rint(mixer.sums() * _UNIT)
    return total / _UNIT


class Spelling:
    """The code of bytes and, by position, the chunks of some words: their bytes and a closing one."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.code = counts, Code(counts)

    def chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 200_000):
        """(first word, one after the last, word of each position, chunk)."""
        sizes = np.cumsum(ends - starts + 1)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, side="right")))
            size = ends[a:b] - starts[a:b] + 1
            word = np.repeat(np.arange(b - a), size)
            place = np.arange(len(word)) - (np.cumsum(size) - size)[word]
            symbol = np.where(place == (size - 1)[word], _CLOSE, data[np.minimum(starts[a:b][word] + place, len(data) - 1)] if len(data) else _CLOSE)
            prior = [np.where(place >= k, np.concatenate([np.zeros(min(k, len(symbol)), dtype=symbol.dtype), symbol[: max(len(symbol) - k, 0)]]), _CLOSE).astype(np.uint64) for k in range(1, 6)]
            packed, contexts = np.zeros(len(symbol), dtype=np.uint64), []
            for k, p in enumerate(prior):
                packed = packed * np.uint64(257) + p
                if k + 1 in (1, 2, 3, 5):
                    contexts.append(_short(packed * _STEP + np.uint64(k)))
            yield a, b, word, Chunk(self.code, self.code.left[symbol], self.code.length[symbol], contexts, place=np.minimum(place, 2).astype(np.uint32))
            a = b

    def log2(self, tables: Tables, mixer: Mixer, data, starts, ends) -> np.ndarray:
        out = np.zeros(len(starts))
        for a, b, word, chunk in self.chunks(data, starts, ends):
            out[a:b] = np.bincount(word, weights=mixer.log2(tables, chunk), minlength=b - a)
        return out


class _Counts:
    """Counts of bits by slot, for each context."""

    def __init__(self, bits):
        self.bits, self.sums = bits, [np.zeros(2 << b, dtype=np.int64) for b in bits]

    def add(self, chunk: Chunk) -> None:
        count(chunk, self.bits, self.sums)

    def blocks(self, name: int = 0):
        """Batches of (block, its counts), those without any left out."""
        for k, own in enumerate(self.sums):
            yield from _dense(own, name + (k << 32))


def _whole(n: int) -> int:
    """The next multiple of a block's size."""
    return -(-n // _BLOCK) * _BLOCK


def _dense(sums: np.ndarray, name: int):
    """Batches of the blocks of a vector that hold a count; blocks are named by `name` and their place."""
    cut = sums.reshape(-1, min(_BLOCK, len(sums)))
    hit = np.flatnonzero(cut.any(axis=1))
    for a in range(0, len(hit), 16):
        yield _block_batch([name + int(i) for i in hit[a : a + 16]], [cut[i] for i in hit[a : a + 16]])


def _block_batch(names, rows) -> pa.RecordBatch:
    """Blocks with their counts as narrow as they fit: the first byte is the width."""

    def packed(row: np.ndarray) -> bytes:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or row.max(initial=0) < 1 << (8 * w - 1))
        return bytes([width]) + row.astype(f"<i{width}").tobytes()

    return pa.RecordBatch.from_arrays([pa.array(names, type=pa.int64()), pa.array([packed(r) for r in rows], type=pa.binary())], ["block", "counts"])


def _summed_blocks(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Adds up blocks of equal name."""

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("counts")):
                raw = x.as_buffer()
                more = np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1)
                own[k] = own[k] + more if k in own else more.astype(np.int64)
        for k in sorted(own):
            # Half as wide for the driver; what a count above 2**24 loses doesn't matter to a ratio.
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int64()), pa.array([own[k].astype(np.float32).tobytes()], type=pa.binary())], ["block", "counts"])

    got = blocks.repartition("block").mapInArrow(add, "block long, counts binary").toArrow()
    return {k: np.frombuffer(x.as_buffer(), dtype=np.float32) for k, x in zip(got.column("block").to_pylist(), got.column("counts"))}


def _filled(blocks: dict[int, np.ndarray], bits) -> list[np.ndarray]:
    """Counts of bits 0 and 1 by slot for each context."""
    out = [np.zeros(2 << b, dtype=np.float32) for b in bits]
    for k, own in blocks.items():
        if k >= 0 and k >> 32 != _SYMBOLS:
            a = (k & 0xFFFFFFFF) * len(own)
            out[k >> 32][a : a + len(own)] = own
    return [np.ascontiguousarray(x.reshape(-1, 2).T) for x in out]


def _symbols(blocks: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Counts of symbols among the blocks."""
    out = np.zeros(_whole(n))
    for k, own in blocks.items():
        if k >> 32 == _SYMBOLS:
            a = (k & 0xFFFFFFFF) * _BLOCK
            out[a : a + _BLOCK] = own
    return out[:n]


def _added(rows: DataFrame, scan, size: int) -> np.ndarray:
    """Sum over tasks of the vector that scan(batches) gives. Parts are whole multiples of 1 / _UNIT, so that
    the total depends on no order."""

    def each(batches):
        sums = np.rint(scan(batches) * _UNIT).astype(np.int64)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], ["at", "s"])

    got = rows.mapInArrow(each, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("s").to_numpy() / _UNIT
    return out


def _words(docs: DataFrame) -> DataFrame:
    """hash, word and count of the training texts' words."""

    def scan(batches):
        for batch in bounded(batches, "text", 4 << 20):
            texts = Texts(batch.column("text")).lowered()
            words = Spans(texts, SPACE)
            hashes = words.hashes()
            order, same = _alike(hashes)
            new = np.flatnonzero(~same)
            first, counts = order[new], np.diff(new, append=len(order))
            keys = hashes[first]
            data = texts.data.tobytes()
            starts, ends = words.starts[first], words.ends[first]
            part = np.cumsum(ends - starts + 24) // (BATCH_BYTES // 4)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else []
            for i, j in zip(cuts, cuts[1:]):
                named = [data[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j].view(np.int64)), pa.array(named, type=pa.binary()), pa.array(counts[i:j].astype(np.int64))], ["h", "word", "c"])

    # By hash and word: sums alone, for which a hash aggregate will do; words that share a hash stay apart.
    return docs.mapInArrow(scan, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


class Model:
    """Codes, tables and mixers of words and of bytes, and how often a spelled word is one spelled before."""

    def __init__(self, own: Vocabulary, spelling: Spelling):
        self.own, self.spelling = own, spelling
        self.word_tables = self.byte_tables = None
        self.word_mixer, self.byte_mixer = Mixer(1 + len(WORD_BITS), True), Mixer(1 + len(BYTE_BITS), False)
        self.again = np.zeros((2, 7))

    def log2(self, got: Positions, n: int) -> np.ndarray:
        """log2 probability of each text."""
        out = np.bincount(got.row, weights=self.word_mixer.log2(self.word_tables, got.chunk), minlength=n)
        if len(got.other):
            words, own = got.words, got.other
            _, first, back = np.unique(got.hashes[own], return_index=True, return_inverse=True)
            spelt = self.spelling.log2(self.byte_tables, self.byte_mixer, words.texts.data, words.starts[own[first]], words.ends[own[first]])[back]
            bucket = _buckets(got.spelled)
            share = (self.again[1] + 0.5) / (self.again.sum(axis=0) + 1.0)
            some = np.where(got.spelled > 0, share[bucket], 0.0)
            again = np.log2(np.maximum(some, 1e-12)) + np.log2(np.maximum(got.times, 1) / np.maximum(got.spelled, 1))
            out += np.bincount(words.row[own], weights=np.where(got.times > 0, again, np.log2(1 - some) + spelt), minlength=n)
        return out


def train(texts: DataFrame, rare: DataFrame, own: Vocabulary, tokens: int, kinds: int) -> Model:
    """texts: `key` (a hash of id and text), `half` (0 or 1, by the text) and `text`, not null; rare: `h` and `word`, the distinct words outside the code;
    how many tokens and words those are."""
    sc = texts.sparkSession.sparkContext

    def letters(batches):
        sums = np.zeros(257)
        for batch in batches:
            t = Texts(batch.column("word"))
            sums[:256] += np.bincount(t.data, minlength=256)
            sums[_CLOSE] += t.n
        return sums

    spelling = Spelling(_added(rare, letters, 257).astype(np.int64) + 1)
    model = Model(own, spelling)
    shared = sc.broadcast((own, spelling))

    def spell(batches):
        _, spelling = shared.value
        sums = _Counts(BYTE_BITS)
        for batch in bounded(batches, "word", 400_000):
            t = Texts(batch.column("word"))
            for *_, chunk in spelling.chunks(t.data, t.starts, t.ends):
                sums.add(chunk)
        yield from sums.blocks()

    def read(batches):
        own, _ = shared.value
        sums, again = [_Counts(WORD_BITS) for _ in range(2)], np.zeros((2, 7), dtype=np.int64)
        symbols = np.zeros((2, _whole(len(own.symbols))), dtype=np.int64)
        for batch in batches:
            for half in (0, 1):
                for got in _reads(own, [batch.filter(pc.equal(batch.column("half"), half))], past=False):
                    sums[half].add(got.chunk)
                    symbols[half] += np.bincount(got.symbol, minlength=symbols.shape[1])
                    for k in (0, 1):
                        of = (got.spelled > 0) & ((got.times > 0) == k)
                        again[k] += np.bincount(_buckets(got.spelled[of]), minlength=7)
        for half in (0, 1):
            yield from sums[half].blocks(half << _HALF)
            yield from _dense(symbols[half], (half << _HALF) + (_SYMBOLS << 32))
        yield _block_batch([-1], [again.reshape(-1)])

    blocks = _summed_blocks(texts.mapInArrow(read, "block long, counts binary"))
    model.again = blocks.get(-1, np.zeros(14)).reshape(2, 7).astype(np.float64)
    halves = [{k & ((1 << _HALF) - 1): x for k, x in blocks.items() if k >= 0 and k >> _HALF == half} for half in (0, 1)]
    filled = [_filled(x, WORD_BITS) for x in halves]
    exact = [own.code.exact(_symbols(x, len(own.symbols))) for x in halves]
    model.word_tables = Tables(own.code.exact(own.symbols), [x + y for x, y in zip(*filled)], WORD_BITS)
    # What a text is learned on is counted in the other half, so that none meets itself or a copy of itself.
    others = [Tables(exact[1 - half], filled[1 - half], WORD_BITS) for half in (0, 1)]
    for tables in (model.word_tables, *others):
        tables.settle()
    blocks = _summed_blocks(rare.mapInArrow(spell, "block long, counts binary"))
    model.byte_tables = Tables(spelling.code.exact(spelling.counts), _filled(blocks, BYTE_BITS), BYTE_BITS)
    shared.destroy()
    shared = sc.broadcast((own, spelling, model.byte_tables, others))

    def mix_bytes(batches):
        _, spelling, tables, _ = shared.value

        def learn(mixer, words, _):
            t = Texts(pa.array(words, type=pa.large_binary()))
            for *_, chunk in spelling.chunks(t.data, t.starts, t.ends):
                mixer.learn(tables, chunk)

        return _learned(_runs(batches, "word", 400_000), lambda: Mixer(1 + len(BYTE_BITS), False), learn)

    def mix_words(batches):
        own, _, _, others = shared.value

        def learn(mixer, texts, shard):
            mixer.learn(others[shard & 1], Positions(own, Texts(pa.array(texts, type=pa.large_string())).lowered()).chunk)

        return _learned(_runs(batches, "text", READ_BYTES), lambda: Mixer(1 + len(WORD_BITS), True), learn)

    words, read_in_order = _dealt(rare, "h", "word", max(1, kinds // SHARD_WORDS)), _dealt(texts, "key", "text", max(1, tokens // SHARD_TOKENS))
    model.byte_mixer.settle(_added(words, mix_bytes, len(model.byte_mixer.sums())))
    model.bits_learned = model.word_mixer.settle(_added(read_in_order, mix_words, len(model.word_mixer.sums())))
    shared.destroy()
    model.byte_tables.settle()
    return model


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_fold: tuple[int, int] = (10, 0), head_words: int = HEAD_WORDS) -> DataFrame:
    """A row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities of the whole text) and bits_per_byte of the text's words, each with one separator.

    Training texts are those whose crc32 of the id modulo held_fold[0] isn't held_fold[1]. Null texts are
    empty: one end token. Rows that repeat an id are scored each by itself, and learned from as often
    as they stand there. Words of equal count go into the code together or not at all. Very long texts and words
    are scored whole, in logarithms throughout. Other columns, whatever their names, are left aside. An empty
    table gives an empty result; without training texts the base score is 0 and the model knows no word.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    held = fold("id", held_fold[0]) == held_fold[1]
    texts = rows.filter(~held & F.col("text").isNotNull()).select(F.xxhash64("id", "text").alias("key"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    vocabulary = written(_words(texts.select("text")))
    ends = rows.filter(~held).count()
    sizes = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), *(F.sum((F.col("c") >= (1 << i)).cast("long")).alias(f"t{i}") for i in range(50))).first()
    total, kinds = (sizes["n"] or 0) + ends, sizes["v"] + (ends > 0)
    norm = float(np.log10(total + 0.1 * (kinds + 1)))
    # A word that stands once is one that the rest of the corpus doesn't know: those tell how to spell new words.
    step = next(i for i in range(1, 51) if i == 50 or (sizes[f"t{i}"] or 0) <= head_words)
    least = 1 << step
    head = vocabulary.filter(F.col("c") >= least).select("h", "c").toArrow()
    keys, order = np.unique(head.column("h").to_numpy().view(np.uint64), return_index=True)
    counts = head.column("c").to_numpy()[order]
    own = Vocabulary(keys, counts, ends, int((sizes["n"] or 0) - counts.sum()))
    model = train(texts, vocabulary.filter(F.col("c") < least).select("h", "word"), own, total, sizes["v"] - (sizes[f"t{step}"] or 0) if step < 50 else sizes["v"])
    shared = spark.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        own = model.own
        logs = np.log10(np.append(own.counts, 1) + 0.1)
        for batch in bounded(batches, "text", READ_BYTES):
            texts = Texts(batch.column("text")).lowered()
            got, n = Positions(own, texts), texts.n
            words, known = got.words, got.known
            base = np.bincount(words.row[known], weights=logs[got.symbol[got.place[known]] - 2], minlength=n) + np.log10(own.ends + 0.1)
            n_known = np.bincount(words.row[known], minlength=n) + (own.ends > 0)
            coded = np.bincount(words.row, weights=words.ends - words.starts + 1, minlength=n).astype(np.int64)
            offsets = pa.array(np.searchsorted(words.row[got.other], np.arange(n + 1)).astype(np.int32))
            rare = pa.ListArray.from_arrays(offsets, pa.array(got.hashes[got.other].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words.per_row().astype(np.int64) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(model.log2(got, n)), pa.array(coded), rare], ["id", "of", "n_tokens", "known", "base", "bits", "coded", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.select("id", F.xxhash64("text").alias("of"), "text")
    first = written(keyed.mapInArrow(scan, f"id {kind}, of long, n_tokens long, known long, base double, bits double, coded long, rare array<long>"))
    # Words outside the code meet their counts in a join. Each distinct (id, text) once: repeated rows share their sums.
    rare = first.filter(F.size("rare") > 0).groupBy("id", "of").agg(F.first("rare").alias("rare"))
    tail = vocabulary.filter(F.col("c") < least).select("h", "c")
    c = F.coalesce("c", F.lit(0))
    counted = rare.select("id", "of", F.explode("rare").alias("h")).join(tail, "h", "left").groupBy("id", "of").agg(F.sum(F.log10(c + F.lit(0.1))).alias("more"), F.sum((c > 0).cast("long")).alias("met"))
    both = first.drop("rare").join(counted.withColumnsRenamed({"id": "i", "of": "o"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")), "left")
    return both.select(
        F.col("id").alias("doc_id"),
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        (-F.col("bits") / F.greatest("coded", F.lit(1))).alias("bits_per_byte"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
