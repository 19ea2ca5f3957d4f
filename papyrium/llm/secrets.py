"""Secret scans by assignment-aware lexing.

Two layers find spans in every whole text. The base layer is three fixed patterns (assigned
credentials, cloud access keys, long hexadecimal runs). The second lexes source and configuration
syntax into name-literal pairs: quoted or bare values after `=`, `:`, `:=` or `=>`, with type
annotations, JSON and YAML keys, and literals joined by `+`. Constants are propagated: a pair whose
value is a name or a join takes the literals that the name was bound to before. Each literal is then
scored by how sensitive the names it flows to are and by its own shape; those above the threshold
become spans of kind `literal`.

A map over the rows with no shuffle; texts without a sensitive stem, separators left aside, skip the
lexer, which could find nothing there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import bounded
from ._session import ship, table

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Sensitive stems of target names and their weights.
STEMS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "authkey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0, "credential": 0.9, "bearer": 0.8, "authorization": 0.7,
}
_FLAT_STEMS = tuple(x.encode() for x in STEMS)
#: What a name may hold beside letters and digits, which sensitivity() leaves aside.
_BETWEEN = b"_$.-" + bytes(range(0x80, 0x100))
_STRING = r"""[rbfuRBFU]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
_PAIR = re.compile(
    rf"""(?<![\w$.-])(?P<name>[\w$.-]++)(?P<close>["'\]]{{0,2}})
    (?:[ \t]*:[ \t]*[A-Za-z_][\w.]*(?:\[[\w., ]*\])?(?=[ \t]*=[^=]))?   # a type annotation
    [ \t]*(?P<op>=>|:=|=(?!=)|:(?!:))[ \t]*
    (?P<value>(?:{_STRING}|[^\s"',;(){{}}\[\]+]+)(?:[ \t]*\+[ \t]*(?:{_STRING}|[^\s"',;(){{}}\[\]+]+))*)""",
    re.VERBOSE,
)
_PART = re.compile(rf"{_STRING}|[^\s\"',;(){{}}\[\]+]+")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*\Z")
#: Placeholders: these words, and what begins like these.
_DULL_WORDS = {"none", "null", "nil", "true", "false", "undefined", "changeme", "placeholder", "redacted", "todo"}
_DULL_HEAD = re.compile(r"\$|example|your[_-]")


def may_assign(low: str) -> bool:
    """Whether a text in lower case can hold a name that sensitivity() weighs: the stems are looked for as it does."""
    flat = low.encode().translate(None, _BETWEEN)
    return any(stem in flat for stem in _FLAT_STEMS)


def sensitivity(name: str) -> float:
    """How strongly a target name speaks for a secret: 0 to 1."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for s, w in STEMS.items() if s in flat), default=0.0)


def _judged(n: float, counts: dict[str, float], dull: bool) -> float:
    """0 to 1, from length, character classes and entropy of what has these counts of characters."""
    if n < 6 or dull or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(re.compile(p).match, counts)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * min(n, 20) / 20 + 0.5 * min(entropy, 3.5) / 3.5 + 0.25 * min(classes, 3) / 3)


#: Characters of a value's beginning and end that tell a placeholder; of the whole, its counts of characters do.
EDGE = 16


def _dull(n: float, counts: dict[str, float], head: str, tail: str) -> bool:
    """Whether a value is a placeholder: one character over and over, something in brackets, a word that says so."""
    low = head.lower()
    return (
        {c.lower() for c in counts} in ({"x"}, {"*"}, {"."})
        or (n <= EDGE and low in _DULL_WORDS)
        or bool(_DULL_HEAD.match(low))
        or (n >= 2 and head[0] + tail[-1] in ("<>", "%%"))
        or (n >= 4 and head[:2] + tail[-2:] == "{{}}")
    )


def shape(literal: str) -> float:
    """How much a literal looks like a credential: 0 to 1."""
    own = _Value()
    own.add(0, literal)
    return own.shape()


class _Value:
    """What a name is bound to: its own literals, the values joined to them, and what shape needs of it all.

    Values form a graph; a value that joins another holds no copy of its literals, so that chains of joins take
    time and memory in proportion to the text.
    """

    __slots__ = ("spans", "parts", "head", "tail", "n", "counts", "best", "score")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.parts: list[_Value] = []
        self.head, self.tail, self.n, self.counts, self.best, self.score = "", "", 0.0, {}, 0.0, 0.0

    def _count(self, n: float, counts) -> None:
        self.n += n
        for c, k in counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + k
        if self.n > 1e100:  # doublings of doublings: only proportions matter
            self.counts = {c: k * 1e-90 for c, k in self.counts.items()}
            self.n *= 1e-90

    def add(self, start: int, literal: str) -> None:
        self.spans.append((start, start + len(literal)))
        counts = Counter(literal)
        self._edges(literal, literal)
        self._count(len(literal), counts)
        self.best = max(self.best, _judged(len(literal), counts, bool(literal) and _dull(len(literal), counts, literal[:EDGE], literal[-EDGE:])))

    def join(self, other: _Value) -> None:
        self.parts.append(other)
        self._edges(other.head, other.tail)
        self._count(other.n, other.counts)
        self.best = max(self.best, other.best)

    def _edges(self, head: str, tail: str) -> None:
        """Both edges after more has been joined; a head shorter than EDGE is all there is."""
        if len(self.head) < EDGE:
            self.head = (self.head + head[:EDGE])[:EDGE]
        self.tail = (self.tail + tail[-EDGE:])[-EDGE:]

    def shape(self) -> float:
        """The shape of the whole, or of its best piece if the whole can be a credential at all."""
        whole = _judged(self.n, self.counts, self.n > 0 and _dull(self.n, self.counts, self.head, self.tail))
        return max(whole, self.best) if whole else 0.0


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals that flow to sensitive names, with their scores."""
    bound: dict[str, _Value] = {}
    values: list[_Value] = []
    for m in _PAIR.finditer(text):
        own = _Value()
        parts = list(_PART.finditer(m["value"]))
        for p in parts:
            raw, at = p[0], m.start("value") + p.start()
            if raw[-1] in "\"'":
                lead = re.match(r"[rbfuRBFU]{0,2}[\"']", raw)
                own.add(at + lead.end(), raw[lead.end() : -1])
            elif raw in bound:
                own.join(bound[raw])
            elif not (_NAME.match(raw) and len(parts) > 1):
                own.add(at, raw.rstrip(".!?*%$&#"))
        bound[m["name"]] = own
        values.append(own)
        weight = sensitivity(m["name"])
        if weight:
            # A bare word after a colon is prose far more often than configuration.
            bare = m["op"] == ":" and not m["close"] and m["value"][0] not in "\"'" and not any(c.isdigit() for c in m["value"])
            # A value in pieces is judged as a whole, and each piece is reported.
            own.score = 0.0 if bare else weight * own.shape()
    found: dict[tuple[int, int], float] = {}
    for own in reversed(values):  # what a value joins was bound before it
        if own.score >= THRESHOLD:
            for part in own.parts:
                part.score = max(part.score, own.score)
            for span in own.spans:
                if span[1] > span[0]:
                    found[span] = max(found.get(span, 0.0), own.score)
    return sorted((a, b, s) for (a, b), s in found.items())


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """Spans of the three fixed patterns: (start, order of kind, kind, end) sorted, as tuples."""
    low = text.lower() if low is None else low
    out = []
    if any(s in low for s in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def find(text: str | None) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """Base spans, and all spans, each by start, then kind."""
    if not text:
        return [], []
    low = text.lower()
    base = base_spans(text, low)
    more = []
    if ("=" in text or ":" in text) and may_assign(low):
        more = [(a, 3, "literal", b) for a, b, _ in literals(text)]
    return base, sorted(base + more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, counts of the base kinds, n_literal, base and spans, the last two as arrays
    of structs (kind, start, end) in code points, ends exclusive.

    Null and empty texts have no spans; rows that repeat an id are scanned each by itself; other
    columns of `docs`, whatever their names, are left aside; an empty table gives an empty result. Very long
    texts are scanned whole, in time in proportion to their length. A name that is bound again takes the later
    value from there on; spans that start together go by kind as listed.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches):
        for batch in bounded(batches):
            base, spans, counts = [], [], {k: [] for k in KINDS}
            for text in batch.column("text").to_pylist():
                own, every = find(text)
                seen = Counter(x[2] for x in every)
                for k in KINDS:
                    counts[k].append(seen[k])
                base.append([{"kind": k, "start": a, "end": b} for a, _, k, b in own])
                spans.append([{"kind": k, "start": a, "end": b} for a, _, k, b in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], type=pa.int64()) for k in KINDS), pa.array(base, type=span), pa.array(spans, type=span)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    kinds = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base {kinds}, spans {kinds}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of the text replaced by `mask`; overlapping spans become one."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts):
        def one(t):
            out, at, done = [], 0, 0
            for a, _, _, b in find(t)[1]:
                if a >= done:
                    out += [t[at:a], mask]
                done = max(done, b)
                at = done
            return t if t is None or not out else "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))


def _listed(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), "n_literal")
