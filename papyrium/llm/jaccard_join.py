"""N-gram Jaccard join with multiple global token orders.

Documents are sets of hashed word shingles; two link when their Jaccard similarity reaches a threshold
t. Of two linking sets of n shingles each shares at least a = ceil(t n), so under any global order their
first n - a + 1 shingles meet. The join goes through filters that all keep every link:

1. Equal sets are one class (128-bit signature); one of them stands for it.
2. Under a hash order, the first 2 (n - a) + 1 shingles of a set share at least half with a partner. Sets
   with fewer shingles that any other class has in its own prefix have no partner.
3. For the rest, shingles that several sets hold are put in three orders that have nothing in common: by
   document frequency, rarest first, and by two hashes. Candidates must meet in the prefixes of all three
   orders, and where they first meet enough of both sets must still lie ahead.
4. Candidates that meet in all of them are verified on whole sets.

Groups of near copies are contracted on the way: first each prefix shingle links its documents to one
of them, and components are formed; then only candidates of different components are paired. So no pair of
different texts is lost for the components, and a group of n copies never becomes n * n / 2 pairs.

Sets of survivors are built in a second pass over the texts. A bitmap of fixed size keeps most other
rows out of the shuffle; the exact join after it decides. Every intermediate is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import SPACE, Spans, Texts, bounded, chained_hashes, mix64, sequence_hash, windows
from ._session import ship, table, written
from .components import components

SHINGLE = 4
NUM, DEN = 85, 100
BITS = 26


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each row, sorted by row, then hash; and set sizes."""
    words = Spans(texts.lowered(), SPACE)
    h = chained_hashes(words.texts.data, words.starts, words.ends)
    first, w = windows(words, h, k)
    row = words.row[first]
    count = words.per_row()
    for m in range(1, k):  # rows of fewer words: the whole sequence is one shingle
        short = np.flatnonzero(count == m)
        if len(short):
            w = np.concatenate([w, sequence_hash(h, m)[words.first[short]]])
            row = np.concatenate([row, short])
    order = np.lexsort((w, row))
    row, w = row[order], w[order]
    if len(row):
        keep = np.ones(len(row), dtype=bool)
        keep[1:] = (row[1:] != row[:-1]) | (w[1:] != w[:-1])
        row, w = row[keep], w[keep]
    return row, w, np.bincount(row, minlength=texts.n)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(values, first)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """_id, n, s1, s2 (signature) and head, the hash-order prefix, of each row."""

    def scan(batches):
        for batch in bounded(batches, "_text"):
            texts = Texts(batch.column("_text"))
            row, w, n = shingle_sets(texts, k)
            first = np.concatenate([[0], np.cumsum(n)[:-1]]) if texts.n else np.zeros(0, dtype=np.int64)
            rank = np.arange(len(row)) - first[row]
            spare = n - (num * n + den - 1) // den
            # A set that one more shingle takes below the threshold links to equal sets only. One without spare
            # shingles may still be part of a larger set (6 of 7 at 0.85), so its head has one shingle.
            size = np.where(den * n >= num * (n + 1), np.minimum(2 * spare + 1, n), 0)
            s1 = _sums(row, mix64(w + np.uint64(1)), texts.n)
            s2 = _sums(row, mix64(w ^ np.uint64(0xA5A5A5A5A5A5A5A5)), texts.n)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(w[rank < size[row]], size)], ["_id", "n", "s1", "s2", "head"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"_id {kind}, n long, s1 long, s2 long, head array<long>")


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**BITS bits, at most 8 MB, with the hashed ids set."""
    k = F.pmod(F.xxhash64(column), F.lit(1 << BITS))
    words = ids.select(F.shiftright(k, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys & ((1 << BITS) - 1)
    return (bits[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1


def _whole_sets(docs: DataFrame, bits: np.ndarray, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        for batch in bounded(batches, "_text"):
            hit = _marked(shared.value, batch.column("_key").to_numpy())
            if hit.any():
                batch = batch.filter(pa.array(hit))
                _, w, n = shingle_sets(Texts(batch.column("_text")), k)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), _lists(w, n)], ["node", "shingles"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.withColumn("_key", F.xxhash64("_id")).mapInArrow(scan, f"node {kind}, shingles array<long>")


def _meeting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet in the prefixes of the second and third order, too."""
    left = nodes.select(F.col("node").alias("a"), F.col("p2").alias("a2"), F.col("p3").alias("a3"))
    right = nodes.select(F.col("node").alias("b"), F.col("p2").alias("b2"), F.col("p3").alias("b3"))
    return pairs.join(left, "a").join(right, "b").filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("_both", both).filter(den * F.col("_both") >= num * (F.size("_sa") + F.size("_sb") - F.col("_both"))).select("a", "b")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, class_id (smallest id with an equal set) and
    component_id (smallest id reachable by links of similarity num / den or more, itself included).

    Words are runs without ASCII white space of the text in lower case (A-Z). A text of fewer than
    `shingle` words has its whole sequence as one shingle. Null, empty and blank texts have no
    shingles and link with nothing. Rows that repeat an id are one node of the graph. Rows with a null id link with
    nothing and get null ids. Ties among shingles in an order go by the shingle's hash, the same for all sets; of
    equal sets the smallest id stands for all. A very long text is one set, gathered in one row.
    Other columns, whatever their names, are left aside. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    signed = written(_signed(rows, shingle, num, den))
    classes = written(signed.filter("n > 0 AND _id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("_id").alias("node")))

    # Filter 2: sets whose prefix other classes share well enough.
    tokens = signed.filter("_id IS NOT NULL").select("_id", "s1", F.explode("head").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo <> hi").select("token"))
    # Fewest shingles that the smallest possible partner's prefix has in common with this one.
    need = F.expr(f"least({den - num} * ((n * {num} + {den - 1}) div {den}) div {den} + 1, size(head))")
    met = tokens.select("_id", "token").join(shared, "token").groupBy("_id").agg(F.count(F.lit(1)).alias("met"))
    reps = signed.join(met, "_id").filter(F.col("met") >= need).select("n", "s1", "s2").distinct()
    survivors = written(classes.join(reps, ["n", "s1", "s2"]).select("node", "n").distinct())
    bits = _bitmap(survivors, "node")
    sets = written(_whole_sets(rows.filter("_id IS NOT NULL"), bits, shingle).join(survivors.select("node").distinct(), "node", "left_semi"))

    # Filter 3: three orders, each the same for all sets. Shingles of one set only meet nobody.
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    frequent = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2"))
    common = each.join(frequent, "token").groupBy("node", "n").agg(F.collect_list(F.struct("df", "token")).alias("common"))
    kept = F.expr(f"size(common) - (n * {num} + {den - 1}) div {den} + 1")  # common shingles in a prefix

    def prefix(place, shown):
        ordered = F.array_sort(F.transform("common", lambda x: F.struct(place(x).alias("place"), x["token"].alias("token"))))
        return F.transform(F.slice(ordered, 1, F.col("q").cast("int")), lambda x: shown(x["token"]))

    nodes = written(
        common.withColumn("q", kept)
        .filter("q > 0")
        .select(
            "node",
            "n",
            (F.col("n") - F.size("common")).alias("alone"),
            F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"),
            # Short hashes do for the second and third filter: by chance they let a pair through, never out.
            prefix(lambda x: x["df"], lambda t: t).alias("p1"),
            prefix(lambda x: F.xxhash64(x["token"]), F.hash).alias("p2"),
            prefix(lambda x: F.hash(x["token"], F.lit(1)), F.hash).alias("p3"),
        )
    )
    # At its first common shingle a pair can still share no more than what either set has from there on.
    fits = f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND {num + den} * least(x.n - x.pos, y.n - y.pos) >= {num} * (x.n + y.n)"
    place = (F.col("alone") + F.col("i")).alias("pos")

    # First round: each prefix shingle links its documents to the one with the most frequent shingles.
    first = nodes.select("node", "n", "weight", "alone", F.posexplode("p1").alias("i", "token")).select("node", "n", "weight", place, "token")
    hubs = written(first.groupBy("token").agg(F.max(F.struct("weight", "node", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("token", "hub.node", "hub.n", "hub.pos"))
    star = first.alias("x").join(hubs.alias("y"), "token").filter(f"x.node <> y.node AND {fits}").select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    links = written(_verified(_meeting(star, nodes), sets, num, den))
    label = written(components(links))

    # Second round: candidates of different components, each at the first shingle that it shares.
    placed = written(nodes.join(label, "node", "left").select("node", "n", "alone", "p1", "p2", "p3", F.coalesce("component", "node").alias("component")))
    where = placed.select("node", "component", "alone", F.posexplode("p1").alias("i", "token")).select("node", "component", place, "token")
    spread = written(where.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token"))
    mixed = written(where.select("node", "pos", "token").join(spread, "token").join(placed, "node"))
    # Each order is the same for all sets, so the first common shingle of x's prefix is also y's first.
    meet = F.expr(
        f"""x.component <> y.component AND x.node < y.node AND {fits}
        AND array_intersect(x.p1, y.p1)[0] = x.token
        AND arrays_overlap(x.p2, y.p2) AND arrays_overlap(x.p3, y.p3)"""
    )
    pairs = mixed.alias("x").join(mixed.alias("y"), (F.col("x.token") == F.col("y.token")) & meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = written(_verified(pairs, sets, num, den))
    final = written(components(links.union(more)))

    named = classes.join(final, "node", "left").select("n", "s1", "s2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    own = signed.select(F.col("_id").alias("doc_id"), "n", "s1", "s2").join(written(named), ["n", "s1", "s2"], "left")
    known = F.col("doc_id").isNotNull()
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id")
