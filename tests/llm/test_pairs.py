import random
from itertools import combinations

from papyrium.llm import jaccard_join
from papyrium.llm.components import components

from .util import SCHEMA, corpus, frame, got, words


def sets(rows, k=4):
    out = {}
    for i, text, *_ in rows:
        w = words(text)
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, num=85, den=100, s=None):
    s = sets(rows) if s is None else s
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(s, 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and den * both >= num * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def test_against_brute_force(spark):
    rows = corpus()
    found = got(jaccard_join.join(frame(spark, rows, extra=True)))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == brute(rows)


def test_group_of_near_copies(spark):
    """A group with copies, links and near misses at a low threshold, where stars alone lose links."""
    import random

    r = random.Random(5)
    base = [f"w{r.randrange(60)}" for _ in range(60)]
    rows = []
    for i in range(70):
        t = base[:]
        for _ in range(r.randint(0, 7)):
            t[r.randrange(60)] = f"w{r.randrange(60)}"
        rows.append((i, " ".join(t), "en", "s", 1))
    for num in (60, 85):
        found = got(jaccard_join.join(frame(spark, rows), num=num))
        assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == brute(rows, num)


def test_smallest_linking_sets(spark):
    """A set with no shingle to spare links to the set of one more that contains it, at several thresholds."""
    rows = []
    for i, n in enumerate(range(1, 26)):
        w = [f"t{i}x{j}" for j in range(n)]
        more = [f"t{i}y"]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w + more)), (3 * i + 2, " ".join(more + w))]
    cycle = [f"c{j}" for j in range(6)]
    rows += [(900, " ".join(cycle * 9)), (901, " ".join(cycle * 9 + ["z"]))]  # 6 of 7 distinct shingles in long texts
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    for num in (50, 60, 85):
        found = got(jaccard_join.join(frame(spark, rows), num=num))
        assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == brute(rows, num)


def test_hard_rows(spark):
    rows = corpus(7)[:6]
    twice = rows + rows[:2] + [(None, rows[0][1], "en", "s", 1), (0, "another text for the same id here", "en", "s", 1)]
    found = jaccard_join.join(frame(spark, twice)).collect()
    assert len(found) == len(twice)
    assert [r for r in found if r["doc_id"] is None][0]["component_id"] is None
    assert {r["component_id"] for r in found if r["doc_id"] == 0} == {0}
    assert jaccard_join.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101), (7, 7), (None, 3), (9, 9)] + [(200, i) for i in range(201, 260)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, **{i: 200 for i in range(200, 260)}}
    assert components(df.filter("a < 0")).count() == 0


def test_words_of_known_collisions(spark):
    """A Thue-Morse word and its complement, which sums of powers modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for n in (1024, 2048, 4096):
        texts = ["".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])]
        found = got(jaccard_join.join(frame(spark, [(i, t, "en", "s", n) for i, t in enumerate(texts)])))
        assert [found[i]["component_id"] for i in (0, 1)] == [0, 1]


def test_chained_hashes_of_equal_and_other_bytes():
    import numpy as np
    import pyarrow as pa

    from papyrium.llm._batch import SPACE, Spans, Texts, chained_hashes

    r = random.Random(1)
    words = ["".join(r.choice("abé") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)]
    texts = [" ".join(words[i : i + r.randrange(1, 9)]) for i in range(0, 3000, 9)] + ["a", "a a", "", None, "aaaaaaaa", "aaaaaaaaa"]
    spans = Spans(Texts(pa.array(texts)), SPACE)
    h = chained_hashes(spans.texts.data, spans.starts, spans.ends)
    names = [spans.texts.data[a:b].tobytes() for a, b in zip(spans.starts, spans.ends)]
    by = {}
    for name, x in zip(names, h.tolist()):
        assert by.setdefault(name, x) == x
    assert len(set(by.values())) == len(by) > 1000
    assert np.array_equal(h, chained_hashes(spans.texts.data, spans.starts, spans.ends))
