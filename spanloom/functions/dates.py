"""Dates with a precision, and ranges of them. Plan-time values; columns use Spark's own date functions."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import QueryError

_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%d.%m.%Y", "%m/%d/%Y", "%a, %d %b %Y %H:%M:%S")
LAST = timedelta(microseconds=1)


def _month(y: int, m: int) -> tuple[datetime, datetime]:
    if not 1 <= m <= 12:
        raise QueryError(125, f"month {m}")
    return datetime(y, m, 1), datetime(y, m, monthrange(y, m)[1]) + timedelta(days=1) - LAST


def bounds(text: str) -> tuple[datetime, datetime]:
    """First and last moment of a date of year, month, day or time precision."""
    x = text.strip()
    if re.fullmatch(r"\d{1,4}", x):
        return datetime(int(x), 1, 1), datetime(int(x), 12, 31) + timedelta(days=1) - LAST
    if m := re.fullmatch(r"(\d{4})-?(\d{2})", x):
        return _month(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", x):
        x = f"{m[1]}-{m[2]}-{m[3]}"
    for f in _FORMATS:
        try:
            d = datetime.strptime(x, f)
        except ValueError:
            continue
        return (d, d + timedelta(seconds=1) - LAST) if "%H" in f else (d, d + timedelta(days=1) - LAST)
    raise QueryError(125, f"not a date: {text}")


def precision(text: str) -> str:
    lo, hi = bounds(text)
    n = hi - lo
    return "year" if n > timedelta(days=200) else "month" if n > timedelta(days=20) else "day" if n > timedelta(hours=20) else "time"


def parse_range(text: str) -> tuple[datetime, datetime]:
    """`a/b`, `a..b`, `a - b` (spaced), `a/+N unit`, or one date, which is its own interval."""
    for sep in ("/", "..", " - "):
        if sep in text:
            a, b = (t.strip() for t in text.split(sep, 1))
            if m := re.fullmatch(r"\+?(\d+)\s*(second|minute|hour|day|week|month|year)s?", b):
                lo = bounds(a)[0]
                return lo, plus(lo, int(m[1]), m[2]) - LAST
            try:
                lo, hi = bounds(a)[0], bounds(b)[1]
            except QueryError:
                continue
            return (lo, hi) if lo <= hi else (bounds(b)[0], bounds(a)[1])
    return bounds(text)


def plus(d: datetime, n: int, unit: str) -> datetime:
    if unit in ("month", "year"):
        k = d.year * 12 + d.month - 1 + n * (12 if unit == "year" else 1)
        y, m = divmod(k, 12)
        return d.replace(year=y, month=m + 1, day=min(d.day, monthrange(y, m + 1)[1]))
    return d + timedelta(**{unit + "s": n})


def navigate(now: datetime, what: str) -> tuple[datetime, datetime]:
    """today, yesterday, tomorrow, last or next week, month, year, as intervals around an explicit now."""
    day = datetime(now.year, now.month, now.day)
    if what in ("today", "yesterday", "tomorrow"):
        d = day + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[what])
        return d, d + timedelta(days=1) - LAST
    step, unit = what.split()
    k = {"last": -1, "this": 0, "next": 1}[step]
    if unit == "week":
        d = day - timedelta(days=day.weekday()) + timedelta(weeks=k)
        return d, d + timedelta(weeks=1) - LAST
    if unit == "month":
        d = plus(day.replace(day=1), k, "month")
        return _month(d.year, d.month)
    return bounds(str(day.year + k))


def timestamp_of(c: Column) -> Column:
    """Column of any of the formats to a timestamp; null where none fits."""
    c = F.trim(c)
    fmts = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "d MMMM yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyyMM", "yyyy-MM", "yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in fmts])


def ttl_minutes(c: Column) -> Column:
    """A time to live in minutes: a number, of seconds, hours, days or weeks if the text says so."""
    n = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("double")
    t = F.lower(c)
    return F.when(F.contains(t, F.lit("sec")), n / 60).when(F.contains(t, F.lit("hour")), n * 60).when(F.contains(t, F.lit("day")), n * 1440).when(F.contains(t, F.lit("week")), n * 10080).otherwise(n)


def expires_at(c: Column, now: Column) -> Column:
    """now plus a time to live; a date instead of a number is the moment itself; months and years go by the calendar."""
    n = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int")
    t = F.lower(c)
    by_calendar = F.when(F.contains(t, F.lit("month")), n).when(F.contains(t, F.lit("year")), n * 12)
    moment = F.when(F.rlike(c, F.lit(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}")), timestamp_of(c))
    minutes = F.make_dt_interval(mins=F.floor(ttl_minutes(c)).cast("int"))
    return F.coalesce(moment, F.when(by_calendar.isNotNull(), F.add_months(now, by_calendar).cast("timestamp")), now + minutes)
