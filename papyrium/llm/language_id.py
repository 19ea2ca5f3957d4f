"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams within words, in sorted hash arrays. A text goes
to the language with the lowest cross-entropy a character, over all its words. Texts whose best
cross-entropy lies beyond the language's limit are rejected. The limit is calibrated on labelled texts that
the models have not seen: between those of the language and those of other languages as they look
where their own model is missing. Both error rates stay with the identifier.

Models are fitted on a bounded, hash-chosen sample of labelled rows (`docs_per_language`), so their size
does not grow with the corpus and they are broadcast. Scoring is a map over the rows with no shuffle:
a task scores a distinct word once, as far as a bounded table of words holds them, and sums them by row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batch import Spans, Texts, bounded
from ._charlm import CharModels
from ._session import beside, quoted, ship, table, without

ORDER = 5
DOCS_PER_LANGUAGE = 600
CALIBRATION_SHARE = 0.25
#: Widening of the limits of rejection, in standard deviations of a text's mean.
WIDEN = 4.0
#: Shorter texts don't tell a foreign language from chance.
FOREIGN_CHARS = 200
#: Words whose scores a task keeps.
WORDS_KEPT = 1 << 18
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: ASCII that is no letter; what of the rest is none is told by _LETTERS.
_BETWEEN = [b for b in range(128) if not chr(b).isalpha()]


def _word_scores(model: CharModels, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the letter runs of each word by class, and their characters."""
    runs, owner = [], []
    for i, w in enumerate(words):
        if w.isalpha():
            runs.append(w.lower())
            owner.append(i)
        else:
            for run in _LETTERS.findall(w):
                runs.append(run.lower())
                owner.append(i)
    logs = np.zeros((len(words), len(model.classes)))
    sizes = np.zeros(len(words), dtype=np.int64)
    if runs:
        p, n = model.log_probs(runs)
        owner = np.array(owner)
        for k in range(p.shape[1]):
            logs[:, k] = np.bincount(owner, weights=p[:, k], minlength=len(words))
        sizes = np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)
    return logs, sizes


class _Known:
    """Scores of words met before in the task, in sorted hash arrays of at most `WORDS_KEPT` words: the
    first ones met, which the frequent words are among. The rest is scored anew each time."""

    def __init__(self, classes: int):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.logs, self.sizes = np.zeros((0, classes)), np.zeros(0, dtype=np.int64)

    def scores(self, model: CharModels, keys: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words by their sorted hashes; word(i) is the i-th one's text."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        logs, sizes = np.zeros((len(keys), self.logs.shape[1])), np.zeros(len(keys), dtype=np.int64)
        logs[hit], sizes[hit] = self.logs[at[hit]], self.sizes[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            logs[new], sizes[new] = _word_scores(model, [word(i) for i in new.tolist()])
            new = new[: max(0, WORDS_KEPT - len(self.keys))]
            if len(new):
                place = np.searchsorted(self.keys, keys[new])
                self.keys = np.insert(self.keys, place, keys[new])
                self.logs, self.sizes = np.insert(self.logs, place, logs[new], axis=0), np.insert(self.sizes, place, sizes[new])
        return logs, sizes


def score_batch(model: CharModels, texts: Texts, known: _Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probability by class and number of predicted characters for each row."""
    texts = texts.lowered()
    words = Spans(texts, _BETWEEN)
    k = len(model.classes)
    if not len(words):
        return np.zeros((texts.n, k)), np.zeros(texts.n, dtype=np.int64)
    keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    data, starts, ends = texts.data.tobytes(), words.starts[first], words.ends[first]
    logs, sizes = (known or _Known(k)).scores(model, keys, lambda i: data[starts[i] : ends[i]].decode("utf-8", "replace"))
    total = np.stack([np.bincount(words.row, weights=logs[back, j], minlength=texts.n) for j in range(k)], axis=1) if k else np.zeros((texts.n, 0))
    return total, np.bincount(words.row, weights=sizes[back], minlength=texts.n).astype(np.int64)


def _limit(own: np.ndarray, sizes: np.ndarray, foreign: np.ndarray) -> tuple[float, float, float, float]:
    """Limit of the cross-entropy of one language, its widening for short texts, and the shares of own texts
    beyond it and of foreign ones within it.

    own: cross-entropies of texts of the language that the models haven't seen, foreign: the lowest ones of
    texts of other languages where their own model is left out. The limit lies in the middle between the two
    where they are apart, else where both errors are least; without foreign texts a fifth above its own.
    """
    spread = float(np.std((own - own.mean()) * np.sqrt(sizes))) if len(own) > 1 else 2.0
    high = float(np.max(own - WIDEN * spread / np.sqrt(sizes)))  # no own text is beyond its limit
    high = max(high, float(np.quantile(own, 0.5)))
    if not len(foreign):
        limit = 1.2 * high
    else:
        low = float(np.quantile(foreign, 0.01))
        if low > high:
            limit = (low + high) / 2
        else:
            steps = np.unique(np.concatenate([own, foreign]))
            wrong = [(own > x).mean() + (foreign <= x).mean() for x in steps]
            limit = float(steps[int(np.argmin(wrong))])
    beyond = float((own > limit + WIDEN * spread / np.sqrt(sizes)).mean())
    return limit, spread, beyond, float((foreign <= limit).mean()) if len(foreign) else 0.0


class Identifier:
    """Models of all languages, the cross-entropy beyond which a text is rejected, how much that widens for
    short texts, and by language the shares of wrongly rejected and wrongly accepted calibration texts."""

    def __init__(self, model: CharModels, limits: np.ndarray, spreads: np.ndarray | None = None, errors: dict[str, tuple[float, float]] | None = None):
        self.model, self.limits = model, limits
        self.spreads = np.zeros(len(limits)) if spreads is None else spreads
        self.errors = errors or {}

    def judge(self, texts: Texts, known: _Known | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (posterior of the language, tempered for length) and rejection of each row."""
        if not self.model.classes:
            return [UNKNOWN] * texts.n, np.zeros(texts.n), np.ones(texts.n, dtype=bool)
        logs, sizes = score_batch(self.model, texts, known)
        entropy = -logs / np.maximum(sizes, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(texts.n), best]
        odds = np.exp(-(entropy - low[:, None]) * np.minimum(np.maximum(sizes, 1), 100)[:, None])
        score = np.where(sizes > 0, 1.0 / odds.sum(axis=1), 0.0)
        langs = [self.model.classes[b] if s else UNKNOWN for b, s in zip(best.tolist(), sizes.tolist())]
        # A short text strays further from its language's mean: the limit widens as 1 / sqrt(n).
        limit = self.limits[best] + WIDEN * self.spreads[best] / np.sqrt(np.maximum(sizes, 1))
        return langs, score, (sizes == 0) | (low > limit)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Identifier:
    """Fits on about `docs_per_language` rows of each language, chosen by a hash of the id.

    Rows without text or label are left out. A share of the sample is kept from the models to calibrate
    the limits on. No labels: an identifier that knows no language.
    """
    spark = ship(labelled.sparkSession)
    rows = labelled.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(lang_col)).alias("_lang"), F.col(quoted(text_col)).alias("_text"))
    counts = {r["_lang"]: r["n"] for r in rows.filter("_lang IS NOT NULL").groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Identifier(CharModels([], order), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_language / counts[lang]))))
    unit = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter("_lang IS NOT NULL AND _text IS NOT NULL").filter(unit < share[F.col("_lang")]).withColumn("_held", F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(1000)) < int(1000 * CALIBRATION_SHARE))
    kinds = "lang string, held boolean, doc long, word string, n long"

    def words(batches):
        for batch in bounded(batches, "_text", 2 << 20):
            langs, held = batch.column("_lang").to_pylist(), batch.column("_held").to_pylist()
            out = []
            for lang, h, text, i in zip(langs, held, batch.column("_text").to_pylist(), batch.column("_key").to_pylist()):
                seen: dict[str, int] = {}
                for w in _LETTERS.findall(text):
                    w = w.lower()
                    seen[w] = seen.get(w, 0) + 1
                out += [(lang, h, i if h else 0, w, n) for w, n in seen.items()]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()))], ["lang", "held", "doc", "word", "n"])

    counted = chosen.withColumn("_key", F.xxhash64("_id", "_text")).mapInArrow(words, kinds).groupBy("lang", "held", "doc", "word").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    lang, held, doc = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "held", "doc"))
    word, n = np.array(got.column("word").to_pylist(), dtype=object), got.column("n").to_numpy().astype(np.float64)
    samples = []
    for x in langs:
        own = (lang == x) & ~held.astype(bool)
        if not own.any():
            own = lang == x
        order_ = np.argsort(word[own].astype(str)) if own.any() else np.zeros(0, dtype=np.int64)
        samples.append((word[own][order_].tolist(), n[own][order_]))
    keep = [i for i, s in enumerate(samples) if s[0]]
    langs, samples = [langs[i] for i in keep], [samples[i] for i in keep]
    if not langs:
        return Identifier(CharModels([], order), np.zeros(0))
    model = CharModels(langs, order).fit(samples)
    limits, spreads, errors = np.full(len(langs), np.inf), np.zeros(len(langs)), {}
    kept_out = np.flatnonzero(held.astype(bool))
    if len(kept_out):
        logs, sizes = model.log_probs(word[kept_out].tolist())
        _, one, back = np.unique(np.stack([np.searchsorted(langs, lang[kept_out].astype(str)), doc[kept_out]]), axis=1, return_index=True, return_inverse=True)
        back = back.reshape(-1)
        chars = np.bincount(back, weights=sizes * n[kept_out])
        entropy = np.stack([np.bincount(back, weights=-logs[:, k] * n[kept_out]) for k in range(len(langs))], axis=1) / np.maximum(chars, 1)[:, None]
        of = lang[kept_out][one]
        for k, x in enumerate(langs):
            own = of == x
            if own.any():
                # Texts of other languages that would go to this one if their own had no model.
                rest = np.where(np.array(langs)[None, :] == of[:, None], np.inf, entropy)
                foreign = ~own & (np.argmin(rest, axis=1) == k) & (chars >= FOREIGN_CHARS)
                limits[k], spreads[k], *both = _limit(entropy[own, k], chars[own], entropy[foreign, k])
                errors[x] = tuple(both)
    return Identifier(model, limits, spreads, errors)


def identify(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, plus lang_pred, score (0 to 1) and rejected.

    Null texts and texts without a letter are `und` with score 0, and rejected. Columns of `docs`
    with these names are replaced, others pass through. Ties go to the language first by name. Rows that repeat
    an id are judged each by itself; an empty table gives an empty result. A very long text is one row
    of one task; its words are scored once each.
    """
    spark = ship(docs.sparkSession)
    docs = without(docs, "lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(identifier)
    more = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))

    def each(batches):
        known = _Known(len(shared.value.model.classes))
        for batch in bounded(batches):
            langs, score, rejected = shared.value.judge(Texts(batch.column("text")), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, type=pa.string()), pa.array(score), pa.array(rejected)], ["row", "text", *(n for n, _ in more)])

    rows, own = beside(docs, text_col)
    out = rows.mapInArrow(each, T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in more)]))
    return out.select(*own.values(), *(n for n, _ in more))


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n))


HELD = 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = fit(docs.filter(fold("doc_id", 4) != HELD))
    out = identify(docs.select("doc_id", "text"), known)
    return out.select("doc_id", (fold("doc_id", 4) == HELD).alias("held_out"), "lang_pred", "score", "rejected")
