r"""Fill-in-middle: texts are cut into prefix, middle and suffix between units, and put in the order a model learns from.

A unit grammar is a pair of neighbouring classes: a unit ends wherever a character of the first class stands
before one of the second. Written as a zero-width pattern `(?<=[before])(?=[after])`, Spark's split cuts at
exactly those places and loses no character, so that the pieces joined are the text. An empty text would be one
empty piece; it has no unit instead. Cuts, form and order are drawn from a hash of the seed and the row's id:
retries and reruns agree, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import packed, quoted, table, without

_SPACE = r"\x20\x09-\x0D"
_ANY = r"\x{0}-\x{10FFFF}"
#: Grammar: (class before a cut, class after it).
GRAMMARS = {
    # white space and the word after it; white space at the end is a unit of its own
    "words": ("^" + _SPACE, _SPACE),
    # a line with its end
    "lines": (r"\n", _ANY),
    # up to the white space after a full stop
    "sentences": (".!?", _SPACE),
}
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def boundary(grammar: str) -> str:
    """The zero-width pattern of a grammar's unit ends."""
    before, after = GRAMMARS[grammar]
    return f"(?<=[{before}])(?=[{after}])"


def units(text: Column, grammar: str = "words") -> Column:
    """The units of a text; none in an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(seed: int, id_: Column) -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of the hex SHA-256 of `seed:id` (null id: `seed:`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that gave `output`. Sentinels stand only where they were put: texts that hold one stay plain."""
    cut = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    psm, spm = (F.concat(*(F.get(cut, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grammar: str = "words", seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All rows and columns of `docs`, plus `n_units`, `form` ("plain", "psm" or "spm"), `prefix_chars` and
    `middle_chars` (code points; null where plain) and `output`.

    `percent` of the texts are cut, of these `spm_percent` in the order suffix, prefix, middle. A text that holds
    a sentinel stays plain. Sentinels begin with a character they don't hold again ("<P>"), so that none can arise where
    a piece of text meets one.

    Null text: empty, no unit, plain, output "". Null id: drawn from the seed alone. Rows that repeat an id are drawn
    alike, each with its own text. Both cuts may fall on one place: the middle is empty then. A very long text is split as
    one row of one task. Columns of `docs` with the names of results are replaced, others pass through, whatever their
    names. An empty table gives an empty result.
    """
    if len({s[:1] for s in sentinels}) != 1 or any(not s or s[0] in s[1:] for s in sentinels) or len(set(sentinels)) != 3:
        raise ValueError("sentinels must be three different strings whose common first character stands in them once")
    p, s, m = (F.lit(x) for x in sentinels)
    docs = without(docs, *RESULTS)
    rows = docs.select(packed(docs), F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    cut = rows.select("row", "text", units(F.col("text"), grammar).alias("units"), F.array(*draws(seed, F.col("id"))).alias("h"))
    n, h = F.size("units"), [F.get("h", F.lit(i)) for i in range(4)]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    held = F.lit(False)
    for x in sentinels:
        held = held | F.contains("text", F.lit(x))
    plain = (n == 0) | held | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    placed = cut.select("row", "text", "units", n.cast("long").alias("n_units"), form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))

    def joined(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))

    a, b = F.col("a"), F.col("b")
    parts = placed.select("row", "text", "n_units", "form", joined(F.lit(0), a).alias("prefix"), joined(a, b - a).alias("middle"), joined(b, F.size("units") - b).alias("suffix"))
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("text"))
    )
    return parts.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns),
        "n_units",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        output.alias("output"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), n AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
