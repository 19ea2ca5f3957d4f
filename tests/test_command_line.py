"""The command line: what it lists, runs, refuses and repairs."""

import json

import pytest

from papyrium import __main__ as m
from papyrium import catalogue


@pytest.fixture
def data(spark, tmp_path):
    rows = [("2024-03-01 10:00:00", 1), ("2024-03-01 11:00:00", 1), ("2024-03-01 12:00:00", 2), ("2024-03-04 09:00:00", 3), (None, 4)]
    spark.createDataFrame(rows, "ts string, user_id long").selectExpr("cast(ts as timestamp) ts", "user_id").write.parquet(f"{tmp_path}/data/events.parquet")
    return f"{tmp_path}/data"


def told(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_list_and_sql(capsys):
    assert m.main(["list"]) == 0
    assert capsys.readouterr().out.split() == sorted(catalogue.QUERIES)
    assert m.main(["sql", "leaderboard_daily"]) == 0
    assert capsys.readouterr().out.strip() == catalogue.ORACLE_SQL["leaderboard_daily"].strip()


def test_run_goes_on_after_a_failure(spark, data, tmp_path, capsys):
    assert m.main(["run", "store_merge", "entries_by_mode", "--data", data, "--out", f"{tmp_path}/out"], spark) == 1
    first, second = told(capsys)
    assert (first["query"], first["status"], second) == ("store_merge", "failed", {"query": "entries_by_mode", "status": "done"})
    assert spark.read.parquet(f"{tmp_path}/out/entries_by_mode").count() > 0


@pytest.mark.parametrize(
    "args",
    [["--key", "2024-03-01"], ["--mode", "daily", "--key", "2024-03-01", "--all"], ["--mode", "weekly", "--key", "2024-03-01"], ["--days", "3", "--all"], ["--days", "0"], ["--mode", "yearly"]],
)
def test_repair_refuses(spark, data, tmp_path, args):
    with pytest.raises(SystemExit) as e:
        m.main(["repair", "--data", data, "--out", f"{tmp_path}/out", *args], spark)
    assert e.value.code == 2


def test_repair(spark, data, tmp_path, capsys):
    out = f"{tmp_path}/out"
    base = ["repair", "--data", data, "--out", out, "--mode", "daily"]
    m.main([*base, "--key", "2024-03-01"], spark)
    assert told(capsys) == [{"mode": "daily", "planned": 1, "made": 1, "keys": ["2024-03-01"]}]
    m.main([*base, "--all", "--dry-run"], spark)
    assert told(capsys) == [{"mode": "daily", "planned": 1, "made": None, "keys": ["2024-03-04"]}]
    m.main([*base, "--all"], spark)
    assert told(capsys)[0]["made"] == 1
    m.main([*base, "--all"], spark)
    assert told(capsys) == [{"mode": "daily", "planned": 0, "made": 0, "keys": []}]
    rows = sorted((r["key"], r["rank"], r["user_id"], r["votes"]) for r in m.boards_of(spark, f"{out}/boards", "daily").collect())
    assert rows == [("2024-03-01", 1, 1, 2), ("2024-03-01", 2, 2, 1), ("2024-03-04", 1, 3, 1)]
    m.main(["repair", "--data", data, "--out", out, "--days", "3", "--now", "2024-03-05 12:00:00"], spark)
    assert {t["mode"] for t in told(capsys)} == set(m.MODES)
