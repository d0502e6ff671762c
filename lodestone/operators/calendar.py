"""Keys of a day book whose year is kept in step with leap years, as expressions of zone-local dates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L

ZONE = "Africa/Cairo"


def leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def local_date(at: Column, days: int = 0, zone: str = ZONE) -> Column:
    """The date of an instant in a zone, some days on. `at`: a timestamp; the session's zone doesn't matter."""
    return F.date_add(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), _as_utc(at))), days)


def _as_utc(at: Column) -> Column:
    """An instant's wall time in UTC, without a zone."""
    return (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000).cast("decimal(18,6)")))


def day_key(date: Column) -> Column:
    """MM-dd of a date. Days after 11 September before a leap year, and January and February of a leap year, have the key of the
    day before; 11 September before a leap year is 02-29. Null stays null."""
    year, month, day = F.year(date), F.month(date), F.dayofmonth(date)
    own, earlier = F.date_format(date, "MM-dd"), F.date_format(F.date_sub(date, 1), "MM-dd")
    before = leap(year + 1)
    return F.when(before & ((month > 9) | ((month == 9) & (day > 11))), earlier).when(before & (month == 9) & (day == 11), F.when(date.isNotNull(), F.lit("02-29"))).when(~(before & (month >= 9)) & leap(year) & (month < 3), earlier).otherwise(own)


def day_of_query(q: Column, now: datetime.datetime | None = None) -> Column:
    """The key of the day that a normalized query asks for (tomorrow, else today); null if for none. `now`: an instant, the
    query's run by default."""
    at = F.current_timestamp() if now is None else F.lit(now)
    held = lambda listed: F.exists(F.array(*[F.lit(w) for w in listed.split(", ")]), lambda w: F.contains(q, w))
    return F.when(held(L.TOMORROW), day_key(local_date(at, 1))).when(held(L.TODAY), day_key(local_date(at)))
