"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is its weighted share of the mix, capped at a multiple of its own size, with the
excess reshared until nothing is above its cap. A document should be taken target / size times. The
whole part of that is given to each document; the fractions are rounded in pairs: of two documents,
one gives words to the other until one fraction is 0 or 1, in a random direction that keeps every
document's expectation and, exactly, the words of the pair. What is left in each bucket of documents is
one fraction, and these residuals go up a reduction tree until a source has one.

A long document as the last one would miss the target by half its words. So about `reserve_rows` documents of
each source stay out of the tree and meet the last residual: from the longest down, each is drawn, and the words that
the draw gains or loses are spread over the fractions of the shorter ones. Expectations stay; what the
source misses is in the order of its shortest reserved document.

Buckets are small and dealt by hash, so a hot source is many buckets; only ids and sizes move. Random
numbers are hashes of ids, so that reruns and retried tasks agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import quoted, ship, table, written

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
CAP = 2.0
BUCKET_ROWS = 256
FAN_IN = 64
RESERVE_ROWS = 192
SEED = 20_240_229
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """A row a source: source, source_size, docs (with words) and target. `sized` has source and size.

    Sources go by code point, null last, and take `weights` in turn. The level at which shares are
    cut is found by a few aggregations over the table of sources, which is never collected.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("docs"))
    ranked = sums.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    schema = T.StructType([T.StructField("source", sized.schema["source"].dataType), *(T.StructField(c, T.LongType()) for c in ("source_size", "docs", "_rank"))])
    place = F.pmod("_rank", F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    sources = written(spark.createDataFrame(ranked, schema).withColumn("_weight", weight))
    first = sources.agg(F.sum("source_size").alias("all"), F.sum("_weight").alias("w")).first()
    words, level, capped = total * (first["all"] or 0), 0.0, -1
    if words:
        level = words / first["w"]
        while True:
            above = F.col("_weight") * F.lit(level) > F.col("source_size") * F.lit(cap)
            x = sources.agg(
                F.sum(F.when(above, 1).otherwise(0)).alias("n"),
                F.sum(F.when(above, F.col("source_size") * F.lit(cap)).otherwise(0.0)).alias("held"),
                F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("w"),
            ).first()
            if x["n"] == capped or not x["w"]:
                break
            capped, level = x["n"], (words - x["held"]) / x["w"]
    return sources.select("source", "source_size", "docs", F.least(F.col("source_size") * F.lit(cap), F.col("_weight") * F.lit(level)).alias("target"))


def _pivot(batches, level: int):
    """Settles sorted rows group by group; of each group the last unsettled row goes out as residual."""
    group, held, schema = None, None, None

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        at = {c: i for i, c in enumerate(schema.names)}
        p, w, u, c, r = (at[x] for x in ("_p", "size", "_u", "copies", "_residual"))
        out = []
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            row = list(row)
            key = (row[at["_source"]], row[at["_bucket"]])
            if key != group:
                if held is not None:
                    held[r] = True
                    out.append(held)
                group, held = key, None
            if not 0.0 < row[p] < 1.0 or row[w] <= 0:
                row[c] += int(row[p] >= 1.0)
                row[p], row[r] = 0.0, False
                out.append(row)
                continue
            if held is None:
                held = row
                continue
            a, b = held, row
            up = min((1.0 - a[p]) * a[w], b[p] * b[w])  # words that b can give to a
            down = min(a[p] * a[w], (1.0 - b[p]) * b[w])  # and a to b
            u01 = (a[u] + b[u] + 0.6180339887498949 * level) % 1.0
            a[u] = b[u] = (a[u] * 0.7548776662466927 + b[u] * 0.5698402909980532 + 0.3819660112501051) % 1.0
            moved = up if u01 * (up + down) < down else -down
            mass = a[p] * a[w], b[p] * b[w]
            a[p], b[p] = (mass[0] + moved) / a[w], (mass[1] - moved) / b[w]
            held = None
            for x in (a, b):
                if x[p] < 1e-12 or x[p] > 1.0 - 1e-12:
                    x[c] += int(x[p] > 0.5)
                    x[p], x[r] = 0.0, False
                    out.append(x)
                elif held is None:
                    held = x
                else:  # both fractions survive only by rounding error: settle the nearer one
                    x[c] += int(x[p] > 0.5)
                    x[p], x[r] = 0.0, False
                    out.append(x)
        if out:
            yield block(out)
    if held is not None:
        held[schema.get_field_index("_residual")] = True
        yield block([held])


def _spread(w: list[float], p: list[float], u: list[float]) -> list[int]:
    """Draws each fraction in turn and spreads what that gains or loses over the later ones."""
    w, p, out = np.array(w, dtype=np.float64), np.array(p, dtype=np.float64), []
    for i in range(len(w)):
        x = int(u[i] < p[i])
        out.append(x)
        owed = (p[i] - x) * w[i]
        rest = slice(i + 1, None)
        for _ in range(8):
            free = (p[rest] > 0) & (p[rest] < 1)
            mass = (w[rest] * free).sum()
            if abs(owed) < 1e-9 or mass <= 0:
                break
            moved = np.clip(p[rest] + free * owed / mass, 0.0, 1.0)
            owed -= ((moved - p[rest]) * w[rest]).sum()
            p[rest] = moved
    return out


def _settle(batches):
    """Sorted rows, source by source, longest first: settles them all."""
    group, rows, schema = None, [], None

    def done():
        at = {c: i for i, c in enumerate(schema.names)}
        for row, x in zip(rows, _spread(*([r[at[c]] for r in rows] for c in ("size", "_p", "_u")))):
            row[at["copies"]] += x
            row[at["_p"]] = 0.0
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        source = schema.get_field_index("_source")
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            if row[source] != group and rows:
                yield done()
                rows = []
            group = row[source]
            rows.append(list(row))
    if rows:
        yield done()


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, reserve_rows: int = RESERVE_ROWS, row_col: str | None = None) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, text_hash, size (words), source_size, target (words of
    the source in the mix), copies and taken (copies * size).

    `total` times all words are shared; no source gets above `cap` times its size, and no document more
    than `cap` copies (rounded up). Null and empty texts have size 0 and no copies. Null sources are one source,
    last in order. Rows that repeat an id are taken each by itself; with `row_col`, a column that numbers the rows of
    `docs`, the result has it as `row`. Equal draws go by id and text. Of a very long text only its words are
    counted. Other columns, whatever their names, are left aside. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    text = F.col(quoted(text_col))
    sized = written(
        docs.select(
            F.col(quoted(id_col)).alias("doc_id"),
            F.col(quoted(source_col)).alias("source"),
            F.xxhash64(text).alias("text_hash"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *([F.col(quoted(row_col)).alias("row")] if row_col else []),
        )
    )
    targets = source_targets(sized, weights, total, cap)
    buckets = max(1, -(-sized.count() // bucket_rows))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = lambda salt: F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed + salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = (
        sized.withColumnRenamed("source", "_from")
        .join(targets, F.col("_from").eqNullSafe(F.col("source")))
        .drop("_from")
        .withColumns({"copies": F.floor(rate).cast("long"), "_p": rate - F.floor(rate), "_u": unit(0), "_residual": F.lit(False)})
        .withColumns({"_source": F.xxhash64("source", F.col("source").isNull()), "_bucket": F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(buckets)).cast("long")})
    )
    late = (unit(2) * F.col("docs") < reserve_rows) & (F.col("_p") > 0)
    rows = written(rows.withColumn("_late", late))
    reserve, rows = rows.filter("_late"), rows.filter("NOT _late")
    done, level = [], 0
    while True:
        dealt = rows.repartition("_source", "_bucket").sortWithinPartitions("_source", "_bucket", "_u", "doc_id", "text_hash")
        settled = written(dealt.mapInArrow(lambda b, level=level: _pivot(b, level), rows.schema))
        done.append(settled.filter(~F.col("_residual")))
        rows = settled.filter("_residual")
        if buckets == 1:
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
        rows = rows.withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("long"))
    last = rows.unionByName(reserve).repartition("_source").sortWithinPartitions("_source", F.desc("size"), "_u", "doc_id", "text_hash")
    done.append(last.mapInArrow(_settle, rows.schema))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row_col else []))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
