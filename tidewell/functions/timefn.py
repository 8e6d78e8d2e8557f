"""Date and time functions. "Now" is always an argument, so results can be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, col


def iso(c: Column | str) -> Column:
    """ISO text to a timestamp; null if it is none."""
    return blank(c).try_cast("timestamp")


def age_days(c: Column | str, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(iso(c))) / 86400.0


def within_days(c: Column | str, days: int, now: Column) -> Column:
    """Checked less than so many days ago; text that is no time was not."""
    return F.coalesce(age_days(c, now) < days, F.lit(False))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two ISO texts, two decimals, 0 where either is no time or they run backwards."""
    return F.greatest(F.lit(0.0), F.coalesce(F.bround((F.unix_micros(iso(end)) - F.unix_micros(iso(start))) / 1e6, 2), F.lit(0.0)))


def is_clock(c: Column | str) -> Column:
    return blank(c).rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def due(now_utc: Column, zone: Column | str, run_time: Column | str, weekdays: Column | str | None, last_date: Column | str) -> Column:
    """A schedule is due: local weekday allowed (null: any), local clock at or past run_time, not yet run on the local date."""
    local = F.from_utc_timestamp(now_utc, col(zone))
    day = F.date_format(local, "EEE")
    allowed = F.lit(True) if weekdays is None else F.coalesce(F.array_contains(col(weekdays), day), F.lit(True))
    return allowed & (F.date_format(local, "HH:mm") >= col(run_time)) & (F.date_format(local, "yyyy-MM-dd") != blank(last_date))


def suppressed_on_enable(now_utc: Column, zone: Column | str, run_time: Column | str) -> Column:
    """The local date that counts as done when a schedule is switched on after today's time; '' otherwise."""
    local = F.from_utc_timestamp(now_utc, col(zone))
    return F.when(F.date_format(local, "HH:mm") >= col(run_time), F.date_format(local, "yyyy-MM-dd")).otherwise("")


WEEK = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def in_week_order(days: Column | str) -> Column:
    """Distinct known weekdays, Monday first."""
    return F.filter(F.array(*map(F.lit, WEEK)), lambda d: F.array_contains(col(days), d))


def posted(c: Column | str, now: Column) -> Column:
    """A posting's free date text as a timestamp: ISO, 'Aug 17, 2026', M/d/yyyy inside it, 'N days ago'; null (oldest) otherwise."""
    s = F.trim(blank(c))
    ago = F.regexp_extract(s, r"(?i)(\d+)\+?\s+days?\s+ago", 1).try_cast("int")
    us = F.regexp_extract(s, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.coalesce(
        iso(s), F.try_to_timestamp(s, F.lit("MMM d, yyyy")), F.try_to_timestamp(F.nullif(us, F.lit("")), F.lit("M/d/yyyy")),
        F.timestamp_seconds(F.unix_timestamp(now) - ago * 86400), F.when(s.rlike("(?i)today"), now),
    )
