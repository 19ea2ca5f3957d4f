"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded, their normalised form is hashed (MD5, 128 bits, so that no two lines of any
corpus meet by chance), distinct documents are counted for each hash, and the lines of frequent
hashes lose their place everywhere but in the smallest doc_id. Hashes, ids and positions are written once
and read for both the count and the join; only they are shuffled up to there. Documents then meet the
positions they lose and are reassembled in order.

Hot lines: distinct (line, document) pairs are dealt by both columns and counts are pre-aggregated. The
frequent hashes are a table of their own, so that adaptive execution can broadcast it while it is small
and split a hot hash of the join over tasks otherwise. Nothing is collected; all expressions are native.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import packed, quoted, table, without, written

_BLANK = " \t\n\u000b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    """The normal form of a line: stripped of ASCII white space, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def _hashed(stripped: Column) -> Column:
    """MD5 of a stripped line, the same for two lines exactly if they differ in the case of A-Z only.

    The UTF-8 bytes are read as Latin-1 and put in lower case, many times as fast as translate(). Besides
    A-Z that changes lead bytes C0 to DE to E0 to FE and no byte that continues a character. Whether one
    or more bytes continue it still tells the two kinds of lead bytes apart, so no two lines become one.
    """
    return F.unhex(F.md5(F.lower(F.decode(stripped.cast("binary"), "ISO-8859-1"))))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All rows and columns of `docs` with the text rebuilt, plus `n_lines` (before) and `n_dropped`.

    A line is dropped if its key has `min_chars` code points or more and stands in `min_docs`
    documents or more, unless this document has the smallest id of those.

    Null or empty text: one empty line, kept; the text becomes "". Rows with a null id keep all
    lines and don't count as holders. Rows that repeat an id count as one document; each row is
    rebuilt from its own text, so that of equal lines within the first holder all stay. Ties don't arise: ids are
    compared, and equal ids are one document. Very long texts are exploded like others: a task holds one text and
    the positions it loses. Further columns pass through, whatever their names; columns of `docs` named
    `n_lines` or `n_dropped` are replaced. An empty table gives an empty result.
    """
    docs = without(docs, "n_lines", "n_dropped")
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    stripped = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)))
    lines = written(
        docs.filter(id_.isNotNull() & text.isNotNull())
        .select(id_.alias("doc"), F.xxhash64(text).alias("of"), F.posexplode(stripped).alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .select("doc", "of", "pos", _hashed(F.col("line")).alias("key"))
    )
    frequent = written(
        lines.select("key", "doc")
        .distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
        .filter(F.col("n") >= min_docs)
        .select("key", "first")
    )
    lost = lines.join(frequent, "key").filter(F.col("doc") > F.col("first")).groupBy("doc", "of").agg(F.collect_set("pos").alias("lost"))
    own = docs.select(packed(docs), id_.alias("doc"), F.xxhash64(text).alias("of"))
    both = own.join(lost.hint("shuffle_hash"), ["doc", "of"], "left")
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    # The split array is bound to a lambda variable so that it is computed once, not once a line.
    rebuilt = F.transform(
        F.array(F.split(body, "\n")),
        lambda whole: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("lost")), lambda i: F.get(whole, i)), "\n"),
    )[0]
    n_lines = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    out = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    out[text_col] = F.when(F.col("lost").isNull(), body).otherwise(rebuilt).alias(text_col)
    return both.select(*out.values(), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed
  WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.first_doc AS dropped
  FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
