"""A small corpus with hard cases, and brute-force versions to hold the operators against."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=1, n=80):
    """Rows with nulls, empty and blank texts, copies, near copies, repeated lines and one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(120)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [say(9) for _ in range(4)]
    texts = []
    for i in range(n):
        lines = [say(r.randint(3, 14)) for _ in range(r.randint(1, 6))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(shared).upper() if r.random() < 0.3 else " " + r.choice(shared) + "\t")
        texts.append("\n".join(lines))
    base = say(90).split()
    for i in range(14):
        copy = base[:]
        for _ in range(i // 2):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[1].upper(), None, "", "   \n\t", "one", "One", "a b", "x" * 5000, say(4000), "Trailing\n\n", "\n", "a\x00b c"]
    langs = ["en", "fr", None]
    return [(i, t, langs[i % 3], None if i % 11 == 0 else f"s{(i % 7) if i % 2 else 0}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS n_words", "'x' AS spans", "2 AS copies", "3 AS token") if extra else df


def got(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
