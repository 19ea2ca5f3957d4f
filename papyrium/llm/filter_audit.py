"""Filter interaction audit: what each filter removes in every order of five, by part of the corpus.

Exact copies are found by sorting. Texts are dealt by ranges of (fingerprint, id), so that a hot group of
copies spreads over as many tasks as it needs, and sorted within each by fingerprint, full text and id. One pass
over each range compares a text with its predecessor and measures the other four filters. What a range can't
tell alone are the runs of its first and last fingerprint, which may go on in its neighbours: these
runs are left open, one row with the text is written for each, and the smallest id over all open runs of a text
decides them.

From there on only ids, parts and masks of failures are left. They meet the labels, and are added up
to one counter for each part and mask (partial sums first, so that a hot part is a row a task). At most 32
counters a part give every figure of all 120 orders: in an order a document falls at the first filter it
fails, so of a mask of k failures each filter takes 120 / k of the orders.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import bounded
from ._session import quoted, ship, table, written

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"


def mask(text: bytes, *, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2) -> int:
    """Failures of the filters A to D as bits, of a text in UTF-8.

    bytes.split() cuts at the six ASCII white space characters and at no others.
    """
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    found = BIT["A"] if len(words) < min_words else 0
    found |= BIT["B"] if 100 * len(set(words)) < distinct_percent * len(words) else 0
    found |= BIT["C"] if 100 * (len(text) - len(text.translate(None, UPPER))) > upper_percent * points else 0
    found |= BIT["D"] if len(text.translate(None, SYMBOLS)) < len(text) else 0
    return found


class _Range:
    """One sorted range of texts, row by row. `rows` gets (id, part, failed, run, n), `edges` (run, print, text, id).

    A run is the rows of one text. Runs of the first and of the last fingerprint are open: those of their rows that no
    smaller id of the range decides carry the run's number and go without the bit of E. Only such rows of the current
    fingerprint are held back, without their texts, and repeated ones as a number.
    """

    def __init__(self):
        self.rows, self.edges = [], []
        self.print = self.text = self.least = None
        self.run = self.group = 0  # runs and fingerprints so far
        self.held, self.open = [], []

    def add(self, print_: bytes, text: bytes, id_, part, failed: int) -> None:
        if print_ != self.print:
            self._close(last=False)
            self.print, self.text, self.group = print_, None, self.group + 1
        if text != self.text:
            self._end_run()
            self.run, self.text, self.least = self.run + 1, text, None
        if id_ is None:
            self.rows.append((None, part, failed, None, 1))
            return
        if self.least is None:
            self.least = id_
        if id_ > self.least:
            self.rows.append((id_, part, failed | BIT["E"], None, 1))
        elif self.held and self.held[-1][:4] == (id_, part, failed, self.run):
            self.held[-1] = (id_, part, failed, self.run, self.held[-1][4] + 1)
        else:
            self.held.append((id_, part, failed, self.run, 1))

    def _end_run(self) -> None:
        if self.text is not None and self.least is not None:
            self.open.append((self.run, self.print, self.text, self.least))

    def _close(self, last: bool) -> None:
        """Ends the current fingerprint."""
        self._end_run()
        edge = last or self.group == 1
        self.rows += [(id_, part, failed, run if edge else None, n) for id_, part, failed, run, n in self.held]
        if edge:
            self.edges += self.open
        self.held, self.open = [], []

    def end(self) -> None:
        if self.print is not None:
            self._close(last=True)


_SCHEMA = pa.schema([("id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("text", pa.string()), ("task", pa.int32())])


def _marked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, failed, run and n of the rows; and for each open run a row with print, text and its smallest id."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    part = F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), part.alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("print"))
    # Ranges are cut by fingerprint and id: a range's sample of keys holds no texts.
    ranged = rows.repartitionByRange("print", "id").sortWithinPartitions("print", "text", "id", "part")

    def scan(batches):
        from pyspark import TaskContext

        task, one = TaskContext.get().partitionId(), _Range()

        def made():
            rows = [*((*r, None, None, task) for r in one.rows), *((i, None, None, r, None, h, t.decode(), task) for r, h, t, i in one.edges)]
            one.rows, one.edges = [], []
            columns = list(zip(*rows)) or [()] * len(_SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

        for batch in bounded(batches):
            texts = pc.cast(batch.column("text"), pa.large_binary()).to_pylist()
            prints, ids, parts = (batch.column(c).to_pylist() for c in ("print", "id", "part"))
            for print_, body, id_, part in zip(prints, texts, ids, parts):
                one.add(print_, body, id_, part, mask(body))
            yield made()
        one.end()
        yield made()

    return ranged.mapInArrow(scan, "id long, part string, failed int, run long, n long, print binary, text string, task int")


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, failed, n): the masks of the filters that rows fail, E by all texts of the table; n equal rows."""
    marked = written(_marked(docs, id_col, text_col, part_col))
    edges = marked.filter(F.col("print").isNotNull()).select("task", "run", "print", "text", "id")
    first = edges.groupBy("print", "text").agg(F.min("id").alias("first"))
    later = edges.join(first, ["print", "text"]).filter(F.col("id") > F.col("first")).select(F.col("task").alias("_task"), F.col("run").alias("_run"))
    rows = marked.filter(F.col("print").isNull()).select("id", "part", "failed", "run", "n", "task")
    # Two numbers for each open run, of which a task has those of two fingerprints: as small as the list of tasks.
    both = rows.join(F.broadcast(later), (F.col("run") == F.col("_run")) & (F.col("task") == F.col("_task")), "left")
    failed = F.when(F.col("_run").isNotNull(), F.col("failed").bitwiseOR(F.lit(BIT["E"]))).otherwise(F.col("failed"))
    return both.select("id", "part", failed.alias("failed"), "n")


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, n, good, toxic: one row for each mask that occurs in a part."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)  # noqa: E731
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(says("quality"), says("toxic"))
    named = failed.filter("id IS NOT NULL").join(known, F.col("id") == F.col("_id"), "left").select("part", "failed", "n", "quality", "toxic")
    nameless = failed.filter("id IS NULL").select("part", "failed", "n", F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic"))
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))  # noqa: E731
    return named.unionByName(nameless).groupBy("part", "failed").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def _sum(of: str, where: str) -> Column:
    return F.expr(f"aggregate(masks, 0L, (s, m) -> s + IF({where}, {of}, 0L))")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text: empty; it is a copy of every other empty text of a smaller id. Null part: the part "". Null id: fails by
    A to D only, and is no original of others. Rows that repeat an id count each; equal ids are no copies of
    each other (nothing is smaller). Rows that repeat id and text go through one task, which holds of them a number.
    Labels that repeat an id count as one: good or toxic if any of them says so; null labels say nothing. Very long texts
    are measured whole. Other columns of both tables, whatever their names, are left aside. An empty table has no part and
    gives no row; without labels nothing is good or toxic.
    """
    sums = counters(failures(docs, id_col=id_col, text_col=text_col, part_col=part_col), labels)
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    rows = parts.select("part", "masks", F.explode(F.array(*(F.lit(o) for o in ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, %s, 1)) - 1)"
    rows = rows.withColumns({"own": F.expr(bit % "step"), "reached": F.expr(f"aggregate(sequence(1, step), 0, (s, i) -> s | {bit % 'i'})")})
    here = "m.failed & own <> 0 AND m.failed & (reached - own) = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        _sum("m.n", "m.failed & reached = 0").alias("kept"),
        _sum("m.n", here).alias("removed"),
        _sum("m.n", "m.failed & own <> 0 AND m.failed & (reached - own) <> 0").alias("redundant"),
        _sum("m.n", "m.failed = own").alias("unique_fails"),
        _sum("m.good", here).alias("good_lost"),
        _sum("m.toxic", here).alias("toxic_lost"),
        _sum(f"m.n * ({len(ORDERS)} div bit_count(m.failed))", "m.failed & own <> 0").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), lab AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         MAP {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} AS fails
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id
), m AS (
  SELECT part, fails, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: fails[k]) AS ks, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY part, fails
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, i::INT AS step, filter_order[i] AS own, string_split(filter_order[1:i - 1], '') AS earlier
  FROM o, range(1, 6) r(i)
), t AS (
  SELECT part, filter_order, step, own, n, good, toxic, list_contains(ks, own) AS fails_own,
         len(list_intersect(ks, earlier)) > 0 AS gone, len(ks) AS k
  FROM m, s
), g AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails_own AND k = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM g
"""
