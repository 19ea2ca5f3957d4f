"""Sources, sinks and streaming on small folders."""

import datetime as dt
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from papyrium.operators import conversations, markup, ranking, reconcile, search
from papyrium.sources import feeds, files, sinks
from papyrium.streaming import boards as streams


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_indexes(spark, tmp_path):
    root = tmp_path / "data"
    put(root / "daily/2024-01-02/index.json", {"key": "2024-01-02", "total": 1, "papers": [{"arxiv_id": "2401.00001", "rank": 1, "upvotes": 5}]})
    put(root / "weekly/2024-W01/index.json", {"mode": "weekly", "papers": [{"arxiv_id": "2401.00001"}, {"arxiv_id": "2401.00002"}]})
    rows = files.scan_indexes(spark, str(root))
    assert [(r["mode"], r["key"]) for r in rows.collect()] == [("daily", "2024-01-02"), ("weekly", "2024-W01")]
    assert files.entries(rows).count() == 3
    assert files.strict_indexes(spark, str(root)).count() == 2
    put(root / "monthly/2024-01/index.json", "{broken")
    assert files.scan_indexes(spark, str(root)).filter("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(ValueError, match="monthly"):
        files.strict_indexes(spark, str(root))


def test_pdfs_and_archives(spark, tmp_path):
    (tmp_path / "2401.00001.pdf").write_bytes(b"%PDF-1.7\n" + b"x" * 11_000 + b"%%EOF\n")
    (tmp_path / "2401.00002.pdf").write_bytes(b"%PDF-1.7\n%%EOF")
    found = {r["arxiv_id"]: r["valid"] for r in files.pdf_files(spark, str(tmp_path)).collect()}
    assert found == {"2401.00001": True, "2401.00002": False}
    for name, member in (("good.tar", "a/b.tex"), ("bad.tar", "../b.tex")):
        with tarfile.open(tmp_path / name, "w") as tar:
            info = tarfile.TarInfo(member)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert reasons == {"good.tar": "", "bad.tar": "path_escape"}


def test_feed(spark):
    xml = """<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title> A
      title </title><summary>Sum</summary><published>2024-01-02T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author>
      <category term="cs.CL"/><category term="cs.AI"/><link title="pdf" href="http://p"/><link href="http://q"/></entry><entry><id>none</id></entry></feed>"""
    rows = feeds.parse_feed(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert len(rows) == 1
    assert (rows[0]["arxiv_id"], rows[0]["title"], rows[0]["authors"], rows[0]["submitted"], rows[0]["categories"], rows[0]["pdf_url"]) == ("2401.00001", "A title", "X, Y", "2024-01-02", ["cs.CL", "cs.AI"], "http://p")
    assert feeds.search_query(["cs.CL"], ["a b", "A  b", "c"]) == '(cat:cs.CL) AND (all:"a b" OR all:"c")'


def test_board_page(spark):
    html = '<a href="/papers/2401.00001">x</a><h3>First <b>T</b></h3><div> 7 </div><a href="/papers/2401.00002"></a><h3>Second</h3><a href="/papers/2401.00001"></a>'
    rows = markup.board_rows(spark.createDataFrame([(1, html), (2, "see 2401.00009 and 2401.00008")], "page int, html string"), "page", "html").orderBy("page", "rank").collect()
    assert [(r["page"], r["id"], r["title"], r["upvotes"]) for r in rows[:2]] == [(1, "2401.00001", "First T", 7), (1, "2401.00002", "Second", 0)]
    assert [r["id"] for r in rows[2:]] == ["2401.00009", "2401.00008"]


def test_merges(spark):
    store = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, s string, t string")
    changes = spark.createDataFrame([(2, "B"), (3, "c")], "id int, s string")
    assert sorted(map(tuple, reconcile.upsert(store, changes, "id").collect())) == [(1, "a", "x"), (2, "B", None), (3, "c", None)]
    merged, counts = reconcile.merge_fields(store, changes, "id", ["s"])
    assert tuple(counts.first()) == (1, 1, 1)
    assert {r["id"]: r["s"] for r in merged.collect()} == {1: "a", 2: "B"}
    folded = reconcile.fold_status(spark.createDataFrame([(1, "ok"), (1, "failed"), (2, None)], "id int, status string"), "id")
    assert {r["id"]: r["status"] for r in folded.collect()} == {1: "failed", 2: "absent"}
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "g int, x string")
    right = spark.createDataFrame([(1, "a"), (1, "c")], "g int, x string")
    assert sorted(map(tuple, reconcile.multiset_difference(left, right, ["g"], "x").collect())) == [(1, "a", 1, 0), (1, "b", 1, 0), (1, "c", 0, 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("daily", "k1", "a", 2, 5, False), ("daily", "k1", "b", 1, 9, True)], "mode string, key string, arxiv_id string, rank int, upvotes int, pdf_failed boolean")
    out = sinks.slim_indexes(rows, "now")
    papers = out.first()["papers"]
    assert [p["arxiv_id"] for p in papers] == ["b", "a"] and papers[0]["pdf_status"] == "failed" and out.first()["total"] == 2
    sinks.write_indexes(out, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 1
    jobs = spark.createDataFrame([("a", "running"), ("b", "error")], "arxiv_id string, status string")
    queued = sinks.enqueue(jobs, spark.createDataFrame([("a",), ("b",), ("c",)], "arxiv_id string"))
    assert {r["arxiv_id"]: r["status"] for r in queued.collect()} == {"a": "running", "b": "queued", "c": "queued"}
    marks = spark.createDataFrame([("l1", "a"), ("l2", "b")], "list_id string, arxiv_id string")
    assert sorted(map(tuple, sinks.move_bookmark(marks, "a", "l1", "l2").collect())) == [("l2", "a"), ("l2", "b")]
    index = spark.createDataFrame([("a", 0), ("b", 1)], "arxiv_id string, pos int")
    new = sinks.insert_first(index, spark.createDataFrame([("c", 9)], "arxiv_id string, pos int"))
    assert [r["arxiv_id"] for r in new.orderBy("pos").collect()] == ["c", "a", "b"]


def test_queue_refuses_whole_batches(spark):
    refs = spark.createDataFrame([("a", "daily", "ok")], "arxiv_id string, mode string, pdf_status string")
    store = spark.createDataFrame([("a", False, None, "ok")], "arxiv_id string, pdf_quality_tainted boolean, pdf_quality_taint_reason string, pdf_status string")
    failures = spark.createDataFrame([("a", "quality.untranslated_prose", 0), ("a", "quality.translation_refusal", 1)], "arxiv_id string, category string, pos int")
    out = sinks.queue_failures(failures, refs, store)
    assert out["store"].first()["pdf_quality_taint_reason"] == "quality.translation_refusal" and out["references"].first()["pdf_status"] == "failed"
    with pytest.raises(ValueError, match="stores"):
        sinks.queue_failures(spark.createDataFrame([("z", "quality.untranslated_prose", 0)], failures.schema), refs, store)
    with pytest.raises(ValueError, match="categories"):
        sinks.queue_failures(spark.createDataFrame([("a", "other", 0)], failures.schema), refs, store)


def test_ranking_rules(spark):
    rows = [("2607.00001", "Planning with agents", "abc planning", ["cs.AI"], "2026-07-20"), ("2607.00002", "Other abc planning", "", ["cs.AI"], None), ("2607.00003", "abc planning survey", "", ["cs.AI"], "2026-07-19")]
    cand = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, categories array<string>, submitted string")
    profiles = ranking.profile_table(spark, [{"slug": "p", "query": "q", "generated_terms": {"must": ["abc planning"], "should": [], "negative": ["survey"]}}])
    votes = spark.createDataFrame([("2607.00001", 4)], "arxiv_id string, votes int")
    seen = spark.createDataFrame([("p", "2607.00001")], "slug string, arxiv_id string")
    found = ranking.rank_candidates(cand, profiles, votes, key_date="2026-07-20").orderBy("rank").collect()
    assert [r["arxiv_id"] for r in found] == ["2607.00001", "2607.00002"] and found[0]["topic_score"] == 1.0 and found[1]["topic_score"] == 0.51
    assert [r["arxiv_id"] for r in ranking.rank_candidates(cand, profiles, votes, key_date="2026-07-20", seen=seen).collect()] == ["2607.00002"]
    assert ranking.rank_candidates(cand, profiles, votes, key_date="2026-07-20", seen=seen, force=True).count() == 2
    terms = spark.range(1).select(ranking.merged_terms(F.array(*map(F.lit, ("ABC  planning", "noise"))), F.array(*map(F.lit, ("abc planning", "x"))), F.array(F.lit("noise"))).alias("t")).first()["t"]
    assert terms == ["ABC planning", "x"]


def test_copy_ratio_and_fuzzy_labels(spark):
    pairs = spark.createDataFrame([(1, 0, "we show that it works", "We show that it works."), (1, 2, "we show that it works", "nous montrons")], "conv_id int, turn int, source string, response string")
    assert [r["turn"] for r in conversations.echoes(pairs).collect()] == [0]
    refs = spark.createDataFrame([("fig:mainn", ["fig:main", "tab:other"]), ("fig:a", ["fig:b", "fig:c"])], "ref string, candidates array<string>")
    assert [r["resolved"] for r in markup.fuzzy_labels(refs).collect()] == ["fig:main", None]


def test_environment_stack(spark):
    text = "\\begin{a}\nx\n\\begin{b} \\end{b}\n\\begin{c}\n\\end{a}\n\\end{z}"
    rows = markup.environment_stack(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("line_no").collect()
    assert [(r["env"], r["depth"]) for r in rows] == [("a", 1), ("a", 1), ("a", 1), ("c", 2), (None, 0), (None, 0)]


def test_blank_search(spark):
    rows = spark.createDataFrame([(1, "The Cat"), (2, None)], "ord int, search_text string")
    assert search.search(rows, "  ").count() == 0
    assert [r["ord"] for r in search.search(rows, " cAT ").collect()] == [1]


def test_streaming_boards_agree_with_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 9, 5), i % 4, "view", 1.0, "{}") for i in range(60)]
    events = spark.createDataFrame(rows, streams.EVENT)
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    from papyrium.operators.boards import board

    want = sorted(map(tuple, board(events, "weekly").select("key", "user_id", "votes", "rank").collect()))
    query = streams.refresh_boards(streams.read_events(spark, str(tmp_path / "events")), str(tmp_path / "out"), "weekly", str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out/board")).select("key", "user_id", "votes", "rank")
    assert sorted(map(tuple, found.collect())) == want
