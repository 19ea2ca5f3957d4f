import hashlib
from collections import defaultdict

from papyrium.llm import line_dedup

from .util import LOWER, SCHEMA, corpus, frame, got

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least=10, docs=2):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= least and i is not None and text is not None:
                holders[key].add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders[k := x.strip(BLANK).translate(LOWER)]) < docs or i is None or min(holders[k]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    rows.append((None, rows[3][1], "en", "s1", 3))
    found = got(line_dedup.dedup_lines(frame(spark, rows, extra=True)))
    want = brute(rows)
    assert len(found) == len(want) == len(rows)
    for i, (n, dropped, text) in want.items():
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["text"]) == (n, dropped, text), i
        assert found[i]["spans"] == "x"


def test_other_threshold(spark):
    rows = corpus(2)
    found = got(line_dedup.dedup_lines(frame(spark, rows), min_docs=5, min_chars=4))
    assert {i: (x["n_lines"], x["n_dropped"], x["text"]) for i, x in found.items()} == brute(rows, 4, 5)


def test_repeated_rows_and_empty_table(spark):
    rows = corpus(3)[:20]
    df = line_dedup.dedup_lines(frame(spark, rows + rows[:4]))
    found = sorted((r["doc_id"], r["text"]) for r in df.collect())
    want = brute(rows)
    assert found == sorted((i, want[i][2]) for i, *_ in rows + rows[:4])
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digest(spark, tmp_path):
    rows = corpus(4)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = got(line_dedup.op4_line_dedup(spark, str(tmp_path)))
    for i, (n, dropped, text) in brute(rows).items():
        assert found[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_main_path_is_native(spark, tmp_path):
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    plan = line_dedup.op4_line_dedup(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_column_name(spark):
    """Callers' columns pass through, whatever their names; those called like results are replaced in any case."""
    from papyrium.llm import decontaminate, html_extract, language_id

    rows = corpus(6)[:30]
    names = ["_lost", "lost", "row", "doc", "of", "key", "pos", "_runs", "runs", "settled", "id", "items", "_html", "html", "a.b", "x`y"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ", ".join([SCHEMA, *(f"`{n.replace('`', '``')}` int" for n in names)]))
    df = df.selectExpr("*", "7 AS N_LINES", "7 AS Rejected", "7 AS N_Hit")

    def same(out, kept):
        for r in out.collect():
            assert all(r[n] == i for i, n in enumerate(names) if n in kept)
        return out.columns

    columns = same(line_dedup.dedup_lines(df), names)
    assert "N_LINES" not in columns and columns.count("n_lines") == 1 and "Rejected" in columns
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    for action in ("report", "spans", "documents"):
        columns = same(decontaminate.find_leaks(df, bench, action=action), set(names) - {"items"})
        assert "N_Hit" not in columns and "a.b" in columns
    assert "text" not in same(html_extract.extract_pages(df, html_col="text", out_col="main"), names)
    known = language_id.fit(df)
    assert "Rejected" not in same(language_id.identify(df, known), names)
