"""Which lines of TeX documents are source data: environments, boxes that say so, and printed prompts.

The marks of each line (begin and end of environments, opening phrases, fields) are found by native expressions,
line by line. What a line is depends on those before it, through a stack of open environments and a mode that lasts; that
state goes over the marks of one document in one small Python function, which looks at no text. Documents are
independent rows: nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import source_data as S
from ..functions.predicates import environment_policy
from ..functions.text import strip_comment

ORDER, START, END, FIELD = 1, 2, 4, 8
LIMIT = 1200


class _Reader:
    """Modes of the lines of one document.

    mark: the line begins or ends an environment that is looked after. Else, by what surrounds it: hard (an
    environment that is never prose), source (a box of source data), prompt (a printed prompt), soft (tables and
    algorithms), body. A box becomes source data by its opening line or by a field inside, the innermost that can
    first, none beyond a box that is one already. A prompt goes on to the end of a listing, a heading or `limit` lines;
    a line that is an order by itself doesn't go on. Blocks are numbered by where what protects them begins.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.open: list[list] = []  # environment, policy, number of its block if it protects
        self.prompt = self.lines = self.blocks = 0

    def line(self, flags: int, marks: list[str]) -> tuple[str, int | None, str, int]:
        begins = bool(flags & START) and not flags & ORDER
        prompted = self.prompt
        if not prompted and flags & (ORDER | START):
            self.blocks += 1
            prompted = self.blocks
        if prompted:
            self.lines += 1
        goes_on = (self.prompt or begins) and not flags & END and self.lines < self.limit
        self.prompt = prompted if goes_on else 0
        self.lines = self.lines if goes_on else 0
        if flags & FIELD:
            for frame in reversed(self.open):
                if frame[1] == "source":
                    break
                if frame[0] in S.FIELD_ENVIRONMENTS:
                    self._protect(frame)
                    break
        around = next((f for p in ("hard", "source") for f in self.open if f[1] == p), None)
        innermost = next((f for f in reversed(self.open) if f[0] != "document"), None)
        name = innermost[0] if innermost else "body"
        structural = any(m[1] != "n" for m in marks)
        if structural:
            out = "mark", around[2] if around else None
        elif around:
            out = around[1], around[2]
        elif prompted:
            out = "prompt", prompted
        else:
            out = ("soft" if innermost and innermost[1] == "soft" else "body"), None
        depth = len(self.open)
        for m in marks:
            self._mark(m, bool(flags & FIELD))
        return *out, name, depth

    def _protect(self, frame: list) -> None:
        self.blocks += 1
        frame[1], frame[2] = "source", self.blocks

    def _mark(self, mark: str, field: bool) -> None:
        """A mark is + or -, a letter for the policy (h, s, b for a box, B for one that says so, n), the name."""
        kind, policy, name = mark[0], mark[1], mark[2:]
        if kind == "+":
            frame = [name, {"h": "hard", "s": "soft"}.get(policy, ""), None]
            if policy == "h":
                self.blocks += 1
                frame[2] = self.blocks
            if policy == "B" or (policy == "b" and field and name in S.FIELD_ENVIRONMENTS):
                self._protect(frame)
            self.open.append(frame)
        else:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name), None)
            if at is not None:
                del self.open[at:]


def _scan(key: str, limit: int):
    def scan(batches):
        for batch in batches:
            lines, found, pos = batch.column("lines"), [], []
            for flags, marks in zip(batch.column("flags").to_pylist(), batch.column("marks").to_pylist()):
                reader = _Reader(limit)
                found += [reader.line(f, m) for f, m in zip(flags, marks)]
                pos += range(1, len(flags) + 1)
            columns = list(zip(*found)) or [()] * 4
            typed = [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()))]
            keys = batch.column(key).take(pc.list_parent_indices(lines))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, type=pa.int32()), pc.list_flatten(lines), *typed], [key, "pos", "line", "mode", "block", "environment", "depth"])

    return scan


def line_modes(docs: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """key, pos (from 1), line, mode, block, environment (the innermost around the line, or body) and depth of each line.

    Null text: one empty line. Comments are left aside. An end without a beginning is ignored; an end closes what was
    opened after its beginning.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def flags(x):
        bits = ((S.is_order, ORDER), (S.starts_block, START), (S.ends_block, END), (S.names_field, FIELD))
        total = F.lit(0)
        for test, bit in bits:
            total = total + F.when(test(x), bit).otherwise(0)
        return total

    def marks(x):
        kinds = F.regexp_extract_all(x, F.lit(r"\\(begin|end)\{([^}]+)\}"), F.lit(1))
        names = F.regexp_extract_all(x, F.lit(r"\\(begin|end)\{([^}]+)\}"), F.lit(2))

        def one(kind, name):
            policy = environment_policy(name)
            box = F.when(S.marks_box(name, x), "B").otherwise("b")
            letter = F.when(policy == "hard", "h").when(policy == "soft", "s").when(policy == "source", box).otherwise("n")
            return F.concat(F.when(kind == "begin", "+").otherwise("-"), letter, name)

        return F.zip_with(kinds, names, one)

    rows = docs.select(key, lines.alias("lines")).withColumn("code", F.transform("lines", strip_comment))
    marked = rows.select(key, "lines", F.transform("code", flags).alias("flags"), F.transform("code", marks).alias("marks"))
    kind = docs.schema[key].dataType.simpleString()
    return marked.mapInArrow(_scan(key, limit), f"{key} {kind}, pos int, line string, mode string, block int, environment string, depth int")
