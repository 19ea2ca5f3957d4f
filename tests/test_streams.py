import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from papyrium.operators import campaign
from papyrium.operators.boards import board
from papyrium.sources import snapshots
from papyrium.streaming import boards as B
from papyrium.streaming import jobs as J
from papyrium.streaming import repair as R

T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def brute_jobs(events, stuck):
    """Events (key, at, kind) in order; jobs as a dict of starts."""
    out, running = [], {}
    for key, at, kind in sorted(events):
        if key in running and at >= running[key] + stuck:
            out.append((key, running.pop(key) + stuck, "timer", "reset"))
        if kind == "request":
            out.append((key, at, kind, "refused" if key in running else "started"))
            running.setdefault(key, at)
        elif key in running and kind in ("done", "error"):
            del running[key]
            out.append((key, at, kind, "finished" if kind == "done" else "failed"))
        else:
            out.append((key, at, kind, "ignored"))
    return sorted(out)


def some_events(n=400):
    r = random.Random(2)
    return [(str(r.randrange(6)), minutes(3 * i), r.choice(["request", "request", "done", "error", "view"])) for i in range(n)]


def test_jobs_in_batch(spark):
    events = some_events()
    df = spark.createDataFrame([*events, (None, T0, "request"), ("x", None, "request")], "key string, at timestamp, kind string").repartition(3)
    found = sorted(map(tuple, J.outcomes(df, stuck=dt.timedelta(minutes=40)).collect()))
    assert found == brute_jobs(events, dt.timedelta(minutes=40)) and any(x[3] == "reset" for x in found)
    assert J.outcomes(df.limit(0)).count() == 0


def stream(spark, rows, schema, path, per=60):
    """Rows as a folder of files, read in order of time."""
    for i in range(0, len(rows), per):
        spark.createDataFrame(rows[i : i + per], schema).coalesce(1).write.parquet(f"{path}/f{i:06d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_jobs_in_a_stream(spark, tmp_path):
    """Any cut into micro-batches gives what the batch form gives; jobs without an end are reset by the timer."""
    events = some_events(240)
    last = [("lonely", minutes(1), "request")]
    end = [("z", minutes(3 * 240 + 600), "view")] * 2
    source = stream(spark, [*last, *events, *end], "key string, at timestamp, kind string", tmp_path / "in")
    before = spark.conf.get(J.STATE_STORE[0], None)
    out = J.stream_outcomes(source, dt.timedelta(minutes=40))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    if before:
        spark.conf.set(J.STATE_STORE[0], before)
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("key <> 'z'").collect()))
    want = brute_jobs([*last, *events], dt.timedelta(minutes=40))
    assert [x for x in found if x[2] != "timer"] == [x for x in want if x[2] != "timer"]
    # the timer also ends what still runs when the events of a key are over
    assert set(x for x in want if x[2] == "timer") <= set(found)
    assert ("lonely", minutes(41), "timer", "reset") in found


def test_late_events(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    r = random.Random(5)
    rows = [(i, T0 + dt.timedelta(hours=i) - dt.timedelta(hours=r.choice([0, 0, 5, 60, 90, 200])), r.randrange(5)) for i in range(300)]
    events = spark.createDataFrame(rows, schema)
    marked = R.with_lateness(events.withColumn("batch", F.floor(F.col("event_id") / 50)), "batch")
    want, high = set(), None
    for b in range(6):
        part = rows[50 * b : 50 * b + 50]
        want |= {i for i, ts, _ in part if high and ts < high - dt.timedelta(days=3)}
        high = max([ts for _, ts, _ in part] + ([high] if high else []))
    assert want and {x["event_id"] for x in marked.filter("behind").collect()} == want
    query = R.route(stream(spark, rows, schema, tmp_path / "in", 50), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(300)
    assert query.exception() is None
    late, kept = (spark.read.parquet(str(tmp_path / "out" / d)).drop("batch") for d in ("late", "events"))
    assert {x["event_id"] for x in late.collect()} == want and kept.count() + late.count() == 300
    # boards without the late events, then made anew where they belong
    old = board(kept, "daily").select("key", "user_id", "votes", "rank")
    plan = R.repair_plan(late, old, "daily", "2024-01-12 12:00:00", 5).cache()
    assert {x["key"] for x in plan.filter("late").collect()} == {ts.strftime("%Y-%m-%d") for i, ts, _ in rows if i in want}
    assert "2024-01-12" not in {x["key"] for x in plan.collect()}
    new = R.repaired_boards(kept.unionByName(late), plan, "daily").select("key", "user_id", "votes", "rank")
    whole = {tuple(x) for x in board(events, "daily").select("key", "user_id", "votes", "rank").collect()}
    done = {x["key"] for x in plan.collect()}
    merged = {tuple(x) for x in new.collect()} | {tuple(x) for x in old.collect() if x["key"] not in done}
    assert merged == whole


def test_missing_boards_and_grace(spark):
    late = spark.createDataFrame([], "ts timestamp")
    have = spark.createDataFrame([("2024-W02",), ("2024-W04",)], "key string")
    plan = R.repair_plan(late, have, "weekly", "2024-02-07 03:00:00", 28)
    assert sorted(map(tuple, plan.collect())) == [("2024-W03", False, True), ("2024-W05", False, True)]
    orphans = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0 + dt.timedelta(days=2))], "arxiv_id string, since timestamp")
    refs = spark.createDataFrame([("b",)], "arxiv_id string")
    assert [x["arxiv_id"] for x in R.past_grace(refs, orphans, "2024-01-04 00:00:00").collect()] == ["a"]


def test_sliding_and_session_windows(spark):
    rows = [(i, T0 + dt.timedelta(minutes=m), u) for i, (m, u) in enumerate([(0, 1), (20, 1), (49, 1), (80, 1), (0, 2), (3000, 2)])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    found = {(x["user_id"], x["session_window"]["start"], x["events"]) for x in B.sessions(events).collect()}
    assert found == {(1, T0, 3), (1, minutes(80), 1), (2, T0, 1), (2, minutes(3000), 1)}
    slid = B.sliding_counts(events, "2 days", "1 day").collect()
    assert {(x["user_id"], x["window"]["start"].day, x["votes"]) for x in slid} == {(1, 31, 4), (1, 1, 4), (2, 31, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)}


def test_snapshots(spark, tmp_path):
    src, root, calls = tmp_path / "src", str(tmp_path / "snap"), []
    spark.range(3).write.parquet(str(src))

    def build():
        calls.append(1)
        return spark.read.parquet(str(src)).withColumn("call", F.lit(len(calls)))

    def take(minute, name="a"):
        return snapshots.snapshot(spark, root, name, build, [str(src)], dt.timedelta(minutes=10), minutes(minute)).first()["call"]

    assert (take(0), take(5), take(9)) == (1, 1, 1)
    assert take(10) == 2  # too old
    spark.range(9).write.mode("append").parquet(str(src))
    assert (take(11), take(12)) == (3, 3)  # a source has changed
    snapshots.invalidate(spark, root, "a", minutes(13))
    assert (take(14), take(15)) == (4, 4)
    assert take(15, "b") == 5 and take(16) == 4
    assert snapshots.latest(spark, root, "none") is None


def test_campaign(spark, tmp_path):
    """Steps repair what they can; a run that dies goes on; nothing is done twice."""
    targets = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(3, "b")], "id int, mode string")
    seen = []

    def step(name, test, fail=False):
        def do(df):
            if fail:
                raise RuntimeError("dead")
            seen.append(name)
            return df.withColumn("repaired", test)

        return name, do

    summary, pdf = F.col("id") < 5, F.col("id") % 3 == 0
    root = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        campaign.run(targets, "id", [step("summary", summary), step("pdf", pdf, fail=True)], root)
    left, report = campaign.run(targets, "id", [step("summary", summary), step("pdf", pdf)], root)
    assert seen == ["summary", "pdf", "summary", "pdf"]
    assert list(map(tuple, report.orderBy("round", F.desc("step")).collect())) == [(1, "summary", 20, 5), (1, "pdf", 15, 5), (2, "summary", 10, 0), (2, "pdf", 10, 0)]
    assert {x["id"] for x in left.collect()} == {i for i in range(5, 20) if i % 3}
    rows = {x["mode"]: (x["targets"], x["repaired"], x["residual"], x["status"]) for x in campaign.outcome(targets, left, "id", ["mode"]).collect()}
    assert rows == {"a": (10, 6, 4, "partial"), "b": (10, 4, 6, "partial")}
    left, report = campaign.run(targets, "id", [step("all", F.lit(True))], str(tmp_path / "other"))
    assert left.count() == 0 and report.count() == 1
    assert campaign.run(targets.limit(0), "id", [step("all", F.lit(True))], str(tmp_path / "none"))[0].count() == 0
