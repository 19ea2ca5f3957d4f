"""Calendar keys of leaderboards: days, ISO weeks and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a board of each mode holds, and when its key is first due (ISO weekday or day of month, hour).
MODES = {
    "daily": {"limit": 3, "trigger_day": None, "trigger_hour": 23},
    "weekly": {"limit": 10, "trigger_day": 6, "trigger_hour": 2},
    "monthly": {"limit": 10, "trigger_day": 28, "trigger_hour": 2},
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_key(when, mode: str) -> Column:
    """The key of a date or timestamp: YYYY-MM-DD, YYYY-Www (ISO week and its year) or YYYY-MM."""
    when = _col(when)
    if mode == "daily":
        return F.date_format(when, "yyyy-MM-dd")
    if mode == "weekly":
        year = F.extract(F.lit("YEAROFWEEK"), when).cast("string")
        return F.concat(F.lpad(year, 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(when).cast("string"), 2, "0"))
    if mode == "monthly":
        return F.date_format(when, "yyyy-MM")
    raise ValueError(f"no such mode: {mode}")


def recent_keys(spark: SparkSession, mode: str, days: int, today: str) -> DataFrame:
    """The distinct keys of the last `days` days, in order; no key for no days."""
    if days <= 0:
        return spark.createDataFrame([], "key string")
    last = F.to_date(F.lit(today))
    each = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return each.select(calendar_key("day", mode).alias("key")).distinct().orderBy("key")


def pending_key(now, mode: str) -> Column:
    """The current key while its first scheduled fetch is still ahead, else null."""
    now = _col(now)
    hour, due = F.hour(now), MODES[mode]["trigger_hour"]
    if mode == "daily":
        ahead = hour < due
    else:
        day = F.weekday(now) if mode == "weekly" else F.dayofmonth(now)
        ahead = (day < MODES[mode]["trigger_day"]) | ((day == MODES[mode]["trigger_day"]) & (hour < due))
    return F.when(ahead, calendar_key(now, mode))


def monday_of(week_key) -> Column:
    """The Monday of an ISO week key; null for a key that is no ISO week."""
    week_key = _col(week_key)
    year = F.regexp_extract(week_key, r"^(\d{4})-W(\d{2})$", 1).try_cast("int")
    week = F.regexp_extract(week_key, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (week - 1) * 7)
    return F.when(calendar_key(monday, "weekly") == week_key, monday)


def week_dates(week_key) -> Column:
    """The seven dates of an ISO week as an array; null for an invalid key."""
    monday = monday_of(week_key)
    return F.when(monday.isNotNull(), F.sequence(monday, F.date_add(monday, 6)))


def last_full_week(today) -> Column:
    """Key of the last ISO week that ended before the week of `today`."""
    return calendar_key(F.date_sub(F.date_trunc("week", _col(today)).cast("date"), 7), "weekly")


def is_valid_key(key, mode: str) -> Column:
    """Whether a key survives a round trip through its date."""
    key = _col(key)
    if mode == "daily":
        ok = key.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(key, "yyyy-MM-dd").isNotNull()
    elif mode == "weekly":
        ok = monday_of(key).isNotNull()
    elif mode == "monthly":
        ok = key.rlike(r"^\d{4}-\d{2}$") & F.try_to_date(F.concat(key, F.lit("-01")), "yyyy-MM-dd").isNotNull()
    else:
        raise ValueError(f"no such mode: {mode}")
    return F.coalesce(ok, F.lit(False))


def freshness(submitted, key_date, window_days: int = 30, unknown: float = 0.2) -> Column:
    """1 on the key's date down to 0 after `window_days`; `unknown` where the date can't be read."""
    day = F.try_to_date(_col(submitted).cast("string"), "yyyy-MM-dd")
    age = F.greatest(F.datediff(_col(key_date), day), F.lit(0))
    return F.when(day.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), 1.0 - age / F.lit(float(window_days))))


def in_grace(modified, now, days: int = 3) -> Column:
    """Whether something was modified less than `days` days before `now`."""
    return _col(now).cast("timestamp").cast("double") - _col(modified).cast("timestamp").cast("double") < days * 86400.0
