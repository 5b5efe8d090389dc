"""Cron lines in columns: a line becomes sets of numbers, and the next time is looked for in them, day by day and then by the minute.

Five fields, with lists, ranges, steps, names of months and days, `?`, `L` (the
last day of a month), `L5` (its last Friday), `5#2` (the second one), or a name
such as @daily. If both days are given, either will do. A line that can't be
read, or an unknown zone, gives no time but a reason. A local time that a zone
skips comes as much later as the clock was put forward; one that it has twice
counts the first time.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines with a name, and the names of months and days.
NAMED = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
#: Days that are looked at first, and in all: leap days come every eight years at worst.
NEAR, FAR = 62, 366 * 8 + 2
PART = r"^(?:[*?]|([0-9]{1,2})(?:-([0-9]{1,2}))?)(?:/([0-9]{1,3}))?$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def numbered(field: Column, names: tuple[str, ...], first: int) -> Column:
    for i, name in enumerate(names):
        field = F.replace(field, F.lit(name), F.lit(str(first + i)))
    return field


def bounds(part: Column, low: int, high: int) -> Column:
    """first, last and step of a part of a field, null if it is none."""
    number = lambda group: F.nullif(F.regexp_extract(part, PART, group), F.lit("")).cast("int")
    first = F.coalesce(number(1), F.lit(low))
    one = number(1).isNotNull() & number(3).isNull()
    last = F.coalesce(number(2), F.when(one, number(1)).otherwise(high))
    step = F.coalesce(number(3), F.lit(1))
    return F.when(part.rlike(PART) & first.between(low, high) & last.between(first, F.lit(high)) & (step >= 1), F.struct(first.alias("first"), last.alias("last"), step.alias("step")))


def numbers(parts: Column, low: int, high: int) -> Column:
    """The numbers that a field's parts name, null if one of them can't be read."""
    every = F.transform(parts, lambda p: bounds(p, low, high))
    return let(every, lambda bs: F.when(F.forall(bs, lambda b: b.isNotNull()), F.array_distinct(F.flatten(F.transform(bs, lambda b: F.sequence(b["first"], b["last"], b["step"]))))))


def masks(line: Column) -> Column:
    """The sets of a line and what is wrong with it: struct<error, minutes, hours, days, months, weekdays, last, nth, any_day, any_weekday>."""
    clean = F.lower(F.trim(line))
    for name, meaning in NAMED.items():
        clean = F.when(clean == name, meaning).otherwise(clean)

    def read(f: Column) -> Column:
        parts = lambda i: F.split(F.get(f, F.lit(i)), ",")
        weekdays = F.split(numbered(F.get(f, F.lit(4)), DAYS, 0), ",")
        month = F.split(numbered(F.get(f, F.lit(3)), MONTHS, 1), ",")
        special = r"^(?:[0-7]#[1-5]|l[0-7])$"
        nth = lambda p: F.struct((F.regexp_extract(p, "([0-7])(?:#|$)", 1).cast("int") % 7).alias("day"), F.nullif(F.regexp_extract(p, "#([1-5])", 1), F.lit("")).cast("int").alias("n"))
        plain_days, plain_weekdays = F.filter(parts(2), lambda p: p != "l"), F.filter(weekdays, lambda p: ~p.rlike(special))
        found = F.struct(
            numbers(parts(0), 0, 59).alias("minutes"), numbers(parts(1), 0, 23).alias("hours"), numbers(plain_days, 1, 31).alias("days"), numbers(month, 1, 12).alias("months"),
            F.transform(numbers(plain_weekdays, 0, 7), lambda d: d % 7).alias("weekdays"), F.array_contains(parts(2), "l").alias("last"),
            F.transform(F.filter(weekdays, lambda p: p.rlike(special)), nth).alias("nth"), F.get(f, F.lit(2)).isin("*", "?").alias("any_day"), F.get(f, F.lit(4)).isin("*", "?").alias("any_weekday"),
        )

        def judged(m: Column) -> Column:
            error = F.when(F.size(f) != 5, "fields")
            for name, column in zip((n for n, *_ in FIELDS), ("minutes", "hours", "days", "months", "weekdays"), strict=True):
                error = error.when(m[column].isNull(), name)
            return F.struct(error.alias("error"), *[m[c].alias(c) for c in ("minutes", "hours", "days", "months", "weekdays", "last", "nth", "any_day", "any_weekday")])

        return let(found, judged)

    return let(F.split(clean, r"\s+"), read)


def fits(m: Column, day: Column) -> Column:
    """Whether a line's masks name a date."""
    weekday = F.dayofweek(day) - 1
    by_day = F.array_contains(m["days"], F.dayofmonth(day)) | (m["last"] & (day == F.last_day(day)))
    nth = F.exists(m["nth"], lambda x: (x["day"] == weekday) & F.when(x["n"].isNull(), F.month(F.date_add(day, 7)) != F.month(day)).otherwise(F.ceil(F.dayofmonth(day) / 7) == x["n"]))
    by_weekday = F.array_contains(m["weekdays"], weekday) | nth
    either = F.when(m["any_day"] | m["any_weekday"], by_day & by_weekday).otherwise(by_day | by_weekday)
    return F.array_contains(m["months"], F.month(day)) & either


def next_time(line: Column, zone: Column, after: Column) -> Column:
    """struct<at, error>: the first time after `after` (UTC, without a zone) that a line names in its zone; null lines and times give neither."""
    known = F.coalesce(zone, F.lit("UTC"))
    real = known.isin(*sorted(zoneinfo.available_timezones()))
    result = lambda at, error: F.struct(at.cast("timestamp_ntz").alias("at"), error.cast("string").alias("error"))
    nothing = F.lit(None)

    def look(m: Column) -> Column:
        today = F.to_date(F.convert_timezone(F.lit("UTC"), known, after))
        days = lambda most: F.slice(F.filter(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.date_add(today, i)), lambda d: fits(m, d)), 1, 2)
        two = let(days(NEAR), lambda near: F.when(F.size(near) == 2, near).otherwise(days(FAR)))
        clock = F.flatten(F.transform(m["hours"], lambda h: F.transform(m["minutes"], lambda x: h * 60 + x)))
        at = lambda d, x: F.convert_timezone(known, F.lit("UTC"), d.cast("timestamp_ntz") + F.make_dt_interval(mins=x))
        times = let(clock, lambda c: F.flatten(F.transform(two, lambda d: F.transform(c, lambda x: at(d, x)))))
        return result(F.array_min(F.filter(times, lambda t: t > after)), nothing)

    found = let(masks(line), lambda m: F.when(m["error"].isNotNull(), result(nothing, m["error"])).otherwise(look(m)))
    return F.when(line.isNull() | after.isNull(), result(nothing, nothing)).when(~real, result(nothing, F.lit("zone"))).otherwise(found)
