import itertools
import random
import re
from collections import Counter

from papyrium.llm import filter_audit

from .util import SCHEMA, corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The letters each row fails, by looking at all other rows."""
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        found = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, *_ in rows),
        }
        out.append({k for k, v in found.items() if v})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, failed = {}, fails(rows)
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[3] or "") == part]
        share = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                share[x] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(x in f for _, f in own) - len(gone),
                    sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def got(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(found) == len(rows)
    return found


def hard(seed):
    """Copies in groups of up to 60, long copies, texts around each limit, rows that repeat an id."""
    r = random.Random(seed)
    rows = corpus(seed, 40)
    for k, n in enumerate((60, 7, 2)):
        text = " ".join(f"w{r.randrange(50 * (k + 1))}" for _ in range(150 + 60 * k)) + ("#" if k == 1 else "")
        rows += [(1000 + 100 * k + i, text, "en", r.choice(["s1", "s2", "", None]), 1) for i in range(n)]
    rows += [(2000 + n, " ".join(f"u{i}" for i in range(n)), "en", "s1", 1) for n in (199, 200, 201)]
    rows += [(2100 + n, " ".join(["a"] * n + [f"b{i}" for i in range(200)]), "en", "s1", 1) for n in (200, 201, 202)]
    rows += [(2200 + n, "A" * n + "a" * (100 - n), "en", "s1", 1) for n in (2, 3)]
    rows += [(2203, "é" * 49 + "A", "en", "s1", 1), (2204, "é" * 48 + "AA", "en", "s1", 1)]
    rows += [(1000, rows[-5][1], "en", "s2", 1), (2001, "twice", "en", "s2", 1), (2001, "twice", "en", "s2", 1), (2001, "twice", "fr", None, 1), (2002, "twice", "fr", None, 1)]
    rows += [(None, "twice", "en", "s1", 1), (None, None, None, None, None), (None, "twice", "en", "s1", 1)]
    r.shuffle(rows)
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 2300, 2)] + [(0, 1, 1), (2, None, 1), (None, 1, 1), (1001, 1, None), (1001, None, None)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = hard(1)
    known = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS part", "1 AS _id", "1 AS n")
    docs = frame(spark, rows).selectExpr("*", "'x' AS part", "1 AS print", "2 AS id", "3 AS run", "4 AS failed", "5 AS quality", "6 AS task")
    assert got(filter_audit.audit(docs.repartition(5), known)) == brute(rows, labels)


def test_ranges_of_copies(spark):
    """One group of copies over many ranges; a range of one row; all texts equal."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, "copy of a text" if i % 3 else f"text {i % 30}", "en", f"s{i % 4}", 1) for i in range(120)]
        assert got(filter_audit.audit(frame(spark, rows), spark.createDataFrame([], LABELS))) == brute(rows, [])
        rows = [(i, None if i % 2 else "", "en", None, 1) for i in range(50)]
        assert got(filter_audit.audit(frame(spark, rows), spark.createDataFrame([], LABELS))) == brute(rows, [])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_fingerprints_of_different_texts():
    """Texts are compared themselves: with one fingerprint for all, any cut into ranges gives the same copies."""
    texts = ["a", "b", "c"]
    rows = [(i, texts[i * i % 3]) for i in range(30)] + [(None, "a"), (7, "b"), (7, "b")]
    for cuts in ((30,), (1, 2, 30), (10, 11, 20, 30)):
        found, edges, begin = [], [], 0
        for task, cut in enumerate(cuts):
            part = [r for r in rows if r[0] is not None and begin <= r[0] < cut] + ([r for r in rows if r[0] is None] if not task else [])
            one = filter_audit._Range()
            for i, text in sorted(part, key=lambda r: (r[1], r[0] is not None, r[0] or 0)):
                one.add(b"same", text.encode(), i, "s", 0)
            one.end()
            found += [(*r, task) for r in one.rows]
            edges += [(r, t, i, task) for r, _, t, i in one.edges]
            begin = cut
        least = {}
        for _, text, i, _ in edges:
            least[text] = min(i, least.get(text, i))
        later = {(run, task) for run, text, i, task in edges if i > least[text]}
        copies = Counter()
        for i, _, failed, run, n, task in found:
            copies[i] += n if failed or (run, task) in later else 0
        assert sum(x[4] for x in found) == len(rows)
        assert copies == Counter(i for i, text in rows if i is not None and any(j is not None and j < i and other == text for j, other in rows))


def test_long_text_and_empty_table(spark):
    long = "word " * 1_200_000
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, long + "x", "en", "t", 1)]
    found = got(filter_audit.audit(frame(spark, rows), spark.createDataFrame([(2, 1, 1)], LABELS)))
    assert found == brute(rows, [(2, 1, 1)])
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


def test_query(spark, tmp_path):
    rows, labels = hard(2)
    rows = list({r[0]: r for r in rows}.values())
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    import duckdb

    found = got(filter_audit.op11_filter_audit(spark, str(tmp_path)))
    assert found == brute(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    other = {(r[0], r[1], r[2]): list(r[3:]) for r in con.execute(filter_audit.SQL).fetchall()}
    assert other == found
