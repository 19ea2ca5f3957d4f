"""Runs the library from a shell.

    python -m papyrium list
    python -m papyrium sql NAME
    python -m papyrium run NAME... --data DIR --out DIR [--format parquet]
    python -m papyrium repair --data DIR --out DIR [--mode MODE [--key KEY]] [--days N | --all] [--now TIME] [--dry-run]

`run` writes each result to a folder of its name below --out and goes on after a query that fails. `repair` makes the
boards that are missing below --out from the events below --data: of the last days, of one key, or of all keys with events.
Every outcome is a line of JSON; the exit code is 1 if anything failed, 2 for arguments that don't go together.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue
from .functions.calendar import MODES, calendar_key, is_valid_key
from .streaming.repair import repair_plan, repaired_boards

BOARD = "mode string, key string, user_id long, votes long, rank int"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="papyrium", description="Queries over document and leaderboard tables.")
    do = out.add_subparsers(dest="command", required=True)
    do.add_parser("list")
    do.add_parser("sql").add_argument("name", choices=sorted(catalogue.ORACLE_SQL), metavar="NAME")
    run_ = do.add_parser("run")
    run_.add_argument("names", nargs="+", choices=sorted(catalogue.QUERIES), metavar="NAME")
    run_.add_argument("--format", default="parquet", choices=("parquet", "json", "orc"))
    mend = do.add_parser("repair")
    mend.add_argument("--mode", choices=sorted(MODES))
    mend.add_argument("--key")
    span = mend.add_mutually_exclusive_group()
    span.add_argument("--days", type=int, default=30)
    span.add_argument("--all", action="store_true", dest="every")
    mend.add_argument("--now", default=None)
    mend.add_argument("--dry-run", action="store_true")
    for p in (run_, mend):
        p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
    return out


def run(spark: SparkSession, names: list[str], data: str, out: str, kind: str = "parquet") -> list[dict]:
    """Writes each query's result; what became of each."""
    done = []
    for name in names:
        try:
            catalogue.QUERIES[name](spark, data).write.mode("overwrite").format(kind).save(f"{out.rstrip('/')}/{name}")
        except PySparkException as e:
            done.append({"query": name, "status": "failed", "error": str(e).splitlines()[0][:300]})
        else:
            done.append({"query": name, "status": "done"})
    return done


def boards_of(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """The boards of a mode that stand below `path`; none where nothing was written yet."""
    try:
        return spark.read.schema(BOARD).parquet(path).filter(F.col("mode") == mode)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BOARD)


def repair(spark: SparkSession, data: str, out: str, modes: list[str], now: str, days: int = 30, key: str | None = None, every: bool = False, dry: bool = False) -> list[dict]:
    """Makes missing boards and writes them beside the others, a folder a key; keys planned and made by mode.

    A key's folder is replaced whole, so that a run that is repeated after a failure leaves the same boards.
    """
    events, path, told = spark.read.parquet(f"{data.rstrip('/')}/events.parquet"), f"{out.rstrip('/')}/boards", []
    for mode in modes:
        have = boards_of(spark, path, mode)
        if key:
            plan = spark.range(1).select(F.lit(key).alias("key"))
        elif every:
            plan = events.select(calendar_key("ts", mode).alias("key")).dropna().distinct().join(have.select("key"), "key", "left_anti")
        else:
            plan = repair_plan(events.limit(0), have, mode, now, days).select("key")
        boards = repaired_boards(events, plan, mode).select(F.lit(mode).alias("mode"), "key", "user_id", "votes", "rank")
        planned = [r["key"] for r in plan.orderBy("key").collect()]
        if not dry:
            boards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "key").parquet(path)
            made = {r["key"] for r in boards_of(spark, path, mode).select("key").distinct().collect()}
        told.append({"mode": mode, "planned": len(planned), "made": None if dry else sum(k in made for k in planned), "keys": planned})
    return told


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.command == "sql":
        print(catalogue.ORACLE_SQL[args.name].strip())
        return 0
    if args.command == "repair" and args.key and (args.every or not args.mode):
        p.error("--key names one board: it takes --mode, and no --all")
    if args.command == "repair" and args.days < 1:
        p.error("--days is at least 1")
    spark = spark or SparkSession.builder.appName("papyrium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        told = run(spark, args.names, args.data, args.out, args.format)
    else:
        if args.key and not spark.range(1).select(is_valid_key(F.lit(args.key), args.mode)).first()[0]:
            p.error(f"{args.key} is no key of {args.mode}")
        now = args.now or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        told = repair(spark, args.data, args.out, [args.mode] if args.mode else list(MODES), now, args.days, args.key, args.every, args.dry_run)
    for line in told:
        print(json.dumps(line, ensure_ascii=False))
    return int(any(line.get("status") == "failed" for line in told))


if __name__ == "__main__":
    sys.exit(main())
