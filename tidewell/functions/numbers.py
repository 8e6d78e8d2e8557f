"""Number functions. Spark's ANSI mode is on, so every cast of text is a try_cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, col


def half_even(c: Column | str) -> Column:
    """Round to an integer, halves to the even neighbour."""
    return F.bround(col(c).cast("double")).cast("bigint")


def half_up(c: Column | str) -> Column:
    """floor(x + 0.5)."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def number(c: Column | str) -> Column:
    """Text to a number, thousands commas dropped; null if it is none."""
    return F.regexp_replace(F.trim(blank(c)), ",", "").try_cast("double")


def integer(c: Column | str) -> Column:
    return half_even(number(c))


def money(c: Column | str) -> Column:
    """1,234 for whole amounts, else 1,234.50."""
    x = col(c).cast("double")
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def confidence(c: Column | str) -> Column:
    """High, Medium, Low as 90, 65, 35; a number as itself; else 0."""
    s = F.lower(F.trim(blank(c)))
    return F.when(s == "high", 90).when(s == "medium", 65).when(s == "low", 35).otherwise(F.coalesce(F.floor(s.try_cast("double")), F.lit(0))).cast("int")


def truthy_text(c: Column | str) -> Column:
    return F.lower(F.trim(blank(c))).isin("true", "yes", "1")


def pages(total: Column | str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(col(total) / size)).cast("bigint")


def scaled(amount: Column | str, unit: Column | str) -> Column:
    """Amounts in million or billion."""
    u = F.lower(blank(unit))
    return number(amount) * F.when(u.startswith("b"), 1e9).when(u.startswith("m"), 1e6).otherwise(1.0)


#: How a pay period is spelt in listings. Fixed values.
PERIODS = {"hourly": "hour", "hour": "hour", "annual": "year", "year": "year", "yearly": "year", "monthly": "month", "month": "month", "weekly": "week", "week": "week", "daily": "day", "day": "day"}
#: Spellings that the digest prints; weeks and days have no suffix there. Fixed values.
PRINTED = {"year": "year", "annual": "year", "hour": "hour", "hourly": "hour", "month": "month", "monthly": "month"}
NOT_POSTED = ("not listed", "unknown", "n/a")


def period(c: Column | str) -> Column:
    """One spelling for each pay period, 'unknown' for the rest."""
    s = F.lower(F.trim(blank(c)))
    out = F.lit("unknown")
    for k, v in PERIODS.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def pay_display(text: Column | str, low: Column | str, high: Column | str, period_: Column | str, currency: Column | str) -> Column:
    """Posted text, else a range, else from / up to, else 'Pay not posted'; with currency sign and period."""
    cur = F.upper(F.coalesce(F.nullif(blank(currency), F.lit("")), F.lit("USD")))
    sign = F.when(cur == "USD", "$").otherwise(F.concat(cur, F.lit(" ")))
    tail, p = F.lit(""), F.lower(F.trim(blank(period_)))
    for spelt, unit in PRINTED.items():
        tail = F.when(p == spelt, f" per {unit}").otherwise(tail)
    lo, hi, posted = F.concat(sign, money(low)), F.concat(sign, money(high)), F.trim(blank(text))
    amount = F.when(hi.isNull(), F.concat(F.lit("From "), lo)).when(lo.isNull(), F.concat(F.lit("Up to "), hi)).otherwise(F.concat(lo, F.lit(" - "), hi))
    return F.when((posted != "") & ~F.lower(posted).isin(*NOT_POSTED), posted).when(lo.isNull() & hi.isNull(), "Pay not posted").otherwise(F.concat(amount, tail))
