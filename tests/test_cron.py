"""Cron lines against a walk over minutes."""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from feedloom.functions import cron

AFTER = dt.datetime(2025, 1, 30, 22, 59)
DAYS = {d: i for i, d in enumerate(cron.DAYS)}


def walk(after, zone, fits, days=800):
    """The first minute after `after` whose local time fits, first ones of repeated hours only."""
    t = after.replace(second=0, tzinfo=dt.timezone.utc)
    for _ in range(days * 1440):
        t += dt.timedelta(minutes=1)
        local = t.astimezone(ZoneInfo(zone))
        if not local.fold and fits(local):
            return t.replace(tzinfo=None)
    return None


def last_day(t):
    return (t + dt.timedelta(days=1)).month != t.month


def weekday(t):
    return t.isoweekday() % 7


LINES = [
    ("0 9 * * *", "Asia/Shanghai", lambda t: (t.hour, t.minute) == (9, 0)),
    ("*/15 8-17 * * MON-fri", "Europe/Berlin", lambda t: t.minute % 15 == 0 and 8 <= t.hour <= 17 and 1 <= weekday(t) <= 5),
    ("@monthly", "UTC", lambda t: (t.day, t.hour, t.minute) == (1, 0, 0)),
    (" @Daily ", None, lambda t: (t.hour, t.minute) == (0, 0)),
    ("30 6 L * ?", "America/New_York", lambda t: (t.hour, t.minute) == (6, 30) and last_day(t)),
    ("0 12 * * fri#2", "UTC", lambda t: (t.hour, t.minute) == (12, 0) and weekday(t) == 5 and (t.day + 6) // 7 == 2),
    ("0 12 * * L5", "UTC", lambda t: (t.hour, t.minute) == (12, 0) and weekday(t) == 5 and (t + dt.timedelta(days=7)).month != t.month),
    ("15 3 1,15 feb,mar 2", "UTC", lambda t: (t.hour, t.minute) == (3, 15) and t.month in (2, 3) and (t.day in (1, 15) or weekday(t) == 2)),
    ("5/20 23 30 * 7", "Australia/Lord_Howe", lambda t: t.minute in (5, 25, 45) and t.hour == 23 and (t.day == 30 or weekday(t) == 0)),
    ("0 0 31 4-6 *", "UTC", lambda t: (t.day, t.hour, t.minute) == (31, 0, 0) and t.month in (4, 5, 6)),
]


def test_lines_equal_a_walk_over_minutes(spark):
    rows = [(i, line, zone) for i, (line, zone, _) in enumerate(LINES)]
    got = spark.createDataFrame(rows, "i int, line string, zone string").select("i", cron.next_time(F.col("line"), F.col("zone"), F.lit(AFTER).cast("timestamp_ntz")).alias("n")).collect()
    for r in got:
        _, zone, fits = LINES[r.i]
        assert (r.n.at, r.n.error) == (walk(AFTER, zone or "UTC", fits), None), LINES[r.i][0]


def test_clocks_that_change_leap_days_and_lines_that_cannot_be_read(spark):
    at = dt.datetime
    rows = [
        ("30 2 * * *", "Europe/Berlin", at(2025, 3, 29, 12, 0), at(2025, 3, 30, 1, 30), None),  # 2:30 isn't there: an hour later
        ("30 2 * * *", "Europe/Berlin", at(2025, 10, 25, 12, 0), at(2025, 10, 26, 0, 30), None),  # there twice: the first
        ("30 2 * * *", "Europe/Berlin", at(2025, 10, 26, 0, 30), at(2025, 10, 27, 1, 30), None),
        ("0 0 29 2 *", "UTC", at(2096, 3, 1), at(2104, 2, 29), None),
        ("0 0 31 2 *", "UTC", at(2025, 1, 1), None, None),
        ("0 9 * *", "UTC", at(2025, 1, 1), None, "fields"), ("60 * * * *", "UTC", at(2025, 1, 1), None, "minute"), ("* 5-3 * * *", "UTC", at(2025, 1, 1), None, "hour"), ("* * 0 * *", "UTC", at(2025, 1, 1), None, "day"),
        ("* * * foo *", "UTC", at(2025, 1, 1), None, "month"), ("* * * * 8", "UTC", at(2025, 1, 1), None, "weekday"), ("*/0 * * * *", "UTC", at(2025, 1, 1), None, "minute"), ("@often", "UTC", at(2025, 1, 1), None, "fields"),
        ("0 0 * * *", "Mars/North", at(2025, 1, 1), None, "zone"), (None, "UTC", at(2025, 1, 1), None, None), ("0 0 * * *", "UTC", None, None, None), ("", "UTC", at(2025, 1, 1), None, "fields"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, line string, zone string, t timestamp_ntz")
    got = {r.i: (r.n.at, r.n.error) for r in df.select("i", cron.next_time(F.col("line"), F.col("zone"), F.col("t")).alias("n")).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows)}
