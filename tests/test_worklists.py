import pytest
from pyspark.sql import functions as F

from papyrium.functions import predicates as P
from papyrium.functions import rewrites as R
from papyrium.operators import reconcile, worklists as W
from papyrium.sources import sinks


def ids(df, key="id"):
    return sorted(r[key] for r in df.collect())


def test_retries_and_attempts(spark):
    rows = [(1, "ok", False, True), (2, "ok", False, False), (3, "failed", None, True), (4, None, True, None), (5, None, None, None), (6, "ok", None, None)]
    entries = spark.createDataFrame(rows, "id int, status string, tainted boolean, valid boolean")
    assert ids(W.retry_candidates(entries, "status", "tainted", F.col("valid"))) == [2, 3, 4, 6]
    a, b = (spark.createDataFrame([(i,) for i in x], "id int") for x in ([1, 1, 2], [2, 3]))
    once = W.attempts([a, b], "id")
    assert sorted(map(tuple, once.collect())) == [(1, 1), (2, 2), (3, 1)]
    assert W.fan_out(once, a, "id").count() == 3
    assert ids(W.common(a, b, ["id"])) == [2]


def test_caps(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(7)], "id int, pos int")
    first, told = W.capped(df, "pos", 3)
    assert ids(first, "pos") == [0, 1, 2] and tuple(told.first()) == (3, 4)
    assert tuple(W.capped(df.limit(0), "pos", 3)[1].first()) == (0, 0)
    cut = W.cut_off(df, ["id"], "pos", 3).collect()
    assert sorted(map(tuple, cut)) == [(0, 0, True), (0, 2, True), (0, 4, True), (1, 1, False), (1, 3, False), (1, 5, False)]


def test_stale_and_requests(spark):
    wanted = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 1, 30)], "id int, policy int, size int")
    noted = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 21, 0), (3, 1, 30, 99)], "id int, policy int, size int, age int")
    assert ids(W.stale(wanted, noted, "id", ["policy", "size"])) == [2]
    assert ids(W.stale(wanted, noted, "id", ["policy", "size"], F.col("age"), 50)) == [2, 3]
    said = spark.createDataFrame([(x,) for x in (None, "  ", "good", "x" * 11, "a\x07b", "-no")], "t string")
    assert [r[0] for r in said.select(W.request_fault(F.col("t"), 10, "^[a-z]")).collect()] == ["missing", "missing", None, "too long", "control character", "not valid"]


def test_topics(spark):
    kind = "slug string, display_name string, updated_at string, enabled boolean"
    old = spark.createDataFrame([("a", "Old", "2024", True), ("b", "B", "2023", False)], kind)
    new = spark.createDataFrame([("a", None, "2026", None), ("c", "C", "2025", None)], kind)
    out = W.upsert_topics(old, new)
    assert [tuple(r) for r in W.list_topics(out).collect()] == [("a", "Old", "2026", True), ("c", "C", "2025", None), ("b", "B", "2023", False)]
    assert [r["slug"] for r in W.list_topics(out, True).collect()] == ["a", "c"]
    assert [r["slug"] for r in W.list_topics(out, False).collect()] == ["b"]


def test_counters_and_inserts(spark):
    rows = [("a", 1, ["x", "y"], ["x"]), ("a", 2, ["y"], ["y", "z"]), ("b", 3, None, ["q"]), ("c", 1, ["q"], None)]
    stats = spark.createDataFrame(rows, "k string, n long, left array<string>, seen array<string>")
    plain = {r["k"]: (r["n"], r["left"]) for r in reconcile.merge_counters(stats, ["k"], ["n"], "left").collect()}
    assert plain == {"a": (3, ["x", "y"]), "b": (3, []), "c": (1, ["q"])}
    more = stats.unionByName(spark.createDataFrame([("a", 0, ["z"], ["x", "z"])], stats.schema))  # a later audit clears x
    assert {r["k"]: r["left"] for r in reconcile.merge_counters(more, ["k"], ["n"], "left", "seen").collect()}["a"] == ["y"]
    index = spark.createDataFrame([("a", 0), ("b", 1)], "arxiv_id string, pos int")
    again = sinks.insert_first(index, spark.createDataFrame([("b", 9), ("d", 0), ("c", 5)], index.schema))
    assert [r["arxiv_id"] for r in again.orderBy("pos").collect()] == ["c", "d", "a", "b"] and again.schema == index.schema


@pytest.mark.parametrize(("text", "want"), [(r"[a=\{x, b=y]", True), (r"[a=x\,, b=y\]]", True), ("[a={x, c=z}, b=y]", True), ("[a=(x], b=y)]", False), ("[a, b=y]", False), ("[a=x=y, b=z]", True), ("[a=, b=z]", False)])
def test_options(text, want):
    assert P.option_list(text) is want


def test_macros_in_one_reading():
    text = r"\newcommand{\me}{x}\newcommand{\mme}{y} \me中 \mme中 \mmme \me\中 \mean中"
    fixed, n = R.separate_macro_glue(text)
    assert fixed == r"\newcommand{\me}{x}\newcommand{\mme}{y} \me{}中 \mme{}中 \mmme \me{}中 \mean中" and n == 3
    assert R.undouble_macro_initials(r"\def\name{X}\nname \nnname \name") == (r"\def\name{X}\name \nnname \name", 1)


def test_boards_survive_a_failed_batch(spark, tmp_path, monkeypatch):
    from papyrium.operators import boards
    from papyrium.streaming import boards as streams

    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", i % 4) for i in range(60)]
    make = lambda part: spark.createDataFrame([(i, t, u, "x", 0.0, "") for i, t, u in part], kind.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    make(rows[:40]).write.parquet(str(tmp_path / "events"))
    run = lambda: streams.refresh_boards(streams.read_events(spark, str(tmp_path / "events")), str(tmp_path / "out"), "weekly", str(tmp_path / "check"))
    run().awaitTermination(120)
    make(rows[40:]).write.mode("append").parquet(str(tmp_path / "events"))
    real, calls = boards.top_n, []

    def broken(*a):
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(boards, "top_n", broken)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    monkeypatch.setattr(boards, "top_n", real)
    query = run()
    query.awaitTermination(120)
    assert calls and query.exception() is None
    totals = {}
    for _, t, u in rows:
        week = "2024-W01" if int(t[8:10]) <= 7 else "2024-W02"
        totals[week, u] = totals.get((week, u), 0) + 1
    found = {(r["key"], r["user_id"]): r["votes"] for r in spark.read.parquet(str(tmp_path / "out/board")).collect()}
    assert found == totals
