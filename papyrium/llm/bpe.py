"""BPE encoding and decoding: exact merges of a public vocabulary in linear time.

A word is a row of symbols: bytes, the last one marked as the word's end. A run of tokens is what merging by rank
gives exactly if every two neighbours are compatible, that is, if merging their joined symbols gives the two
again; so no merge is ever carried out. An Aho-Corasick automaton of the reversed tokens reads a word once from its
end and tells for each place the longest token that begins there. From the start the longest token compatible with
the one before is taken, then the next shorter; a place where none fits is marked and left for good by taking back one
token, so that each place is tried once. Decoding is one gather of bytes through the vocabulary's offset table.

The tables come from one tokenizer file that the driver reads; they are as large as the vocabulary, and broadcast.
Texts are independent rows: nothing is shuffled. Each task keeps codes of words it has met, bounded in bytes.
"""

from __future__ import annotations

import gc
import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batch import bounded
from ._session import packed, quoted, ship, table, without

#: The file whose ids the query gives.
FILE = "word_bpe_49k.json"
_END = 256  # added to a word's last byte
_SHIFT = 20  # of a token in a pair's key
#: The normal form the fast path knows, as it stands in a tokenizer file.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: From U+0300 on, normal form and classes of letters depend on the version of Unicode; lines that hold such are cut by the tokenizer library.
_LATER = re.compile("[^\u0000-˿]")
CACHE_BYTES = 64 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of one BPE vocabulary with word ends. Tokens are numbered by rank: symbols first, then merges in order."""

    def __init__(self, spec: dict):
        model, normal = spec["model"], spec["normalizer"]
        cut, as_bytes = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["unk_token"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("not a plain BPE vocabulary with word ends")
        if normal != {"type": "Sequence", "normalizers": NORMAL} or cut["behavior"] != "Removed" or not cut["invert"] or as_bytes["type"] != "ByteLevel" or as_bytes["add_prefix_space"] or as_bytes["use_regex"]:
            raise ValueError("not the normal form or the words that this encoder knows")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or spec["decoder"] or spec["post_processor"]:
            raise ValueError("added tokens other than plain strings, or a decoder of its own")
        self.pattern, suffix, vocab = cut["pattern"]["Regex"], model["end_of_word_suffix"], model["vocab"]
        letters = byte_letters()
        self.ids, spelled, number = [0] * (2 * _END), [(s,) for s in range(2 * _END)], {}
        for letter, byte in letters.items():
            for symbol, name in ((byte, letter), (byte + _END, letter + suffix)):
                self.ids[symbol], number[name] = vocab[name], symbol
        self.left, self.right, self.pairs = [*range(2 * _END)], [*range(2 * _END)], {}
        for merge in model["merges"]:
            a, b = (number[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            name = "".join(merge) if not isinstance(merge, str) else merge.replace(" ", "")
            if name in number:
                raise ValueError(f"two merges give {name}")
            self.pairs[a << _SHIFT | b] = number[name] = len(self.left)
            self.left.append(a)
            self.right.append(b)
            self.ids.append(vocab[name])
            spelled.append(spelled[a] + spelled[b])
        self.size = [len(s) for s in spelled]
        self._automaton(spelled)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: n for n, i in vocab.items()} | {i: n for n, i in self.added.items()}
        rows = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(rows), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.known = np.array([i in names for i in range(len(rows))])

    def _automaton(self, spelled: list[tuple[int, ...]]) -> None:
        """Trie of the reversed tokens that merging can reach, links to shorter ones, the longest token at each state;
        and for each token the longest that begins it."""
        reached = [True] * len(spelled)
        for t in range(2 * _END, len(spelled)):
            a, b = self.left[t], self.right[t]
            reached[t] = reached[a] and reached[b] and self._apart(a, b, t)
        self.step, self.found, self.fail = {}, [-1], [0]
        edges = [{}]
        for t, symbols in enumerate(spelled):
            if reached[t]:
                state = 0
                for s in reversed(symbols):
                    nxt = edges[state].get(s)
                    if nxt is None:
                        edges[state][s] = nxt = len(edges)
                        edges.append({})
                        self.found.append(-1)
                        self.fail.append(0)
                    state = nxt
                self.found[state] = t
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for s, nxt in edges[state].items():
                self.step[state << 9 | s] = nxt
                if state:
                    back = self.fail[state]
                    while back and s not in edges[back]:
                        back = self.fail[back]
                    self.fail[nxt] = edges[back].get(s, 0)
                if self.found[nxt] < 0:
                    self.found[nxt] = self.found[self.fail[nxt]]
                queue.append(nxt)
        begins = {s: t for t, s in enumerate(spelled) if reached[t]}
        self.shorter = [next((begins[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in begins), -1) for s in spelled]

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether merges of a rank under `before` leave tokens a and b as they are when they stand side by side.

        The two are taken apart again in the order opposite to that of merging, as far as their common border is
        concerned. Had the two pieces at the border a merge that comes before the step just undone, that merge would
        have come first. Of equal ranks the left one is merged first, so the right one is undone first.
        """
        while True:
            merged = self.pairs.get(a << _SHIFT | b)
            if merged is not None and merged < before:
                return False
            whole = 2 * _END
            if a > b and a >= whole:
                before, a = a, self.right[a]
            elif b >= whole:
                before, b = b + 1, self.left[b]
            else:
                return True

    def start(self) -> None:
        """What a worker builds for itself."""
        self.words = regex.compile(self.pattern)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.codes, self.held, self.apart, self.library = {}, 0, {}, None
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        gc.freeze()  # the tables stay: the collector needn't walk them

    def word(self, symbols: list[int]) -> list[int]:
        """Tokens of one word."""
        step, fail, found, size, shorter, apart = self.step, self.fail, self.found, self.size, self.shorter, self.apart
        n, state = len(symbols), 0
        longest = [0] * n
        for i in range(n - 1, -1, -1):
            s = symbols[i]
            nxt = step.get(state << 9 | s)
            while nxt is None and state:
                state = fail[state]
                nxt = step.get(state << 9 | s)
            state = nxt
            longest[i] = found[state]
        out, at, last, token, dead = [], 0, -1, longest[0], bytearray(n + 1)
        while True:
            end = at + size[token]
            fits = not dead[end]
            if fits and last >= 0:
                key = last << _SHIFT | token
                fits = apart.get(key)
                if fits is None:
                    if len(apart) > 1 << 20:
                        apart.clear()
                    fits = apart[key] = self._apart(last, token, len(size))
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                back = out.pop()
                at -= size[back]
                last, token = out[-1] if out else -1, shorter[back]

    def _code(self, word: bytes) -> bytes:
        symbols = list(word)
        symbols[-1] += _END
        return b"".join([self.packed[t] for t in self.word(symbols)])

    def _cut(self, text: str) -> list[bytes | str]:
        """The words of a text in normal form."""
        if not _LATER.search(text):
            return self.words.findall(text.lower())
        out = []
        for line in text.split("\n"):
            if not _LATER.search(line):
                out += self.words.findall(line.lower())
                continue
            if self.library is None:
                from tokenizers import Regex, normalizers, pre_tokenizers

                normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
                cut = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
                self.library = normal, cut
            normal, cut = self.library
            out += [w for w, _ in cut.pre_tokenize_str(normal.normalize_str(line))]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32 bits each, low byte first."""
        if self.held > CACHE_BYTES:
            self.codes.clear()
            self.held = 0
        codes, out = self.codes, []
        for k, piece in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[piece].to_bytes(4, "little"))
                continue
            words = self._cut(piece)
            for w in set(words).difference(codes):
                codes[w] = code = self._code(w.encode())
                self.held += len(w) + len(code) + 200
            out.append(b"".join(map(codes.__getitem__, words)))
        return b"".join(out)

    def decode(self, codes: list[bytes]) -> pa.Array:
        """The tokens of each row of ids with one space between; ids the vocabulary doesn't have are left out."""
        ids = np.frombuffer(b"".join(codes), dtype="<u4").astype(np.int64)
        row = np.repeat(np.arange(len(codes)), [len(c) // 4 for c in codes])
        have = ids < len(self.known)
        have[have] = self.known[ids[have]]
        ids, row = ids[have], row[have]
        length = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(length)
        data = self.blob[np.repeat(self.offset[ids] - ends + length, length) + np.arange(ends[-1] if len(ids) else 0)]
        # The last token of a row goes without the space that follows it in the table.
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(ids) else []
        data = np.delete(data, ends[last] - 1)
        size = np.bincount(row, weights=length, minlength=len(codes)).astype(np.int64)
        size[size > 0] -= 1
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def load(path: str) -> Vocabulary:
    """Reads a tokenizer file (JSON) on the driver."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def _over(df: DataFrame, vocabulary: Vocabulary, in_col: str, new: list[tuple[str, T.DataType]], work) -> DataFrame:
    """All columns of `df` but `in_col`, plus `new`; work(vocabulary, column) gives the new arrays of a batch."""
    ship(df.sparkSession)
    rest = without(df, *(c for c, _ in new))
    rows = rest.select(packed(without(rest, in_col)), F.col(quoted(in_col)).alias("in"))
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        own = sent.value
        if not hasattr(own, "codes"):
            own.start()
        for batch in bounded(batches, "in"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), *work(own, batch.column("in"))], ["row", *(c for c, _ in new)])

    out = rows.mapInArrow(scan, T.StructType([rows.schema["row"], *(T.StructField(c, t) for c, t in new)]))
    kept = [F.col("row").getField(c).alias(c) for c in rest.columns if c.lower() != in_col.lower()]
    return out.select(*kept, *(c for c, _ in new))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` but the text, plus `n_tokens` and `ids` (binary: 32 bits an id, low byte first).

    Added tokens of the vocabulary that stand in a text are tokens, as the tokenizer library has it. Null and empty texts,
    and those of white space, have no tokens. Rows that repeat are encoded each; ties don't arise: merges
    have one order. A very long text, or word, is encoded whole, in time that grows with its length. Columns named
    `n_tokens` or `ids` are replaced, others pass through, whatever their names. An empty table gives an empty result.
    """

    def work(own, column):
        codes = [own.encode(t or "") for t in column.to_pylist()]
        return pa.array([len(c) // 4 for c in codes], type=pa.int64()), pa.array(codes, type=pa.binary())

    return _over(docs, vocabulary, text_col, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], work)


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All rows and columns of `encoded` but the ids, plus the text `out_col`: the vocabulary's tokens with single spaces
    between, word ends and special tokens included. No ids (or null): "". Unknown ids are left out."""

    def work(own, column):
        return (own.decode([c or b"" for c in column.to_pylist()]).cast(pa.string()),)

    return _over(encoded, vocabulary, ids_col, [(out_col, T.StringType())], work)


def op13_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """`path`: the tokenizer file; without one, that of the installed package of public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    vocabulary = load(path)
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    digested = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(digested, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
