"""Time stamps, report dates and report windows."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
STRICT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"


def strict_ms(text: Column) -> Column:
    """Epoch milliseconds of YYYY-MM-DDTHH:MM:SS[.mmm] with Z or an offset; null for any other form."""
    return F.when(text.rlike(STRICT), F.unix_millis(text.try_cast("timestamp")))


def epoch_ms(number: Column) -> Column:
    """Milliseconds of a number that counts seconds or milliseconds, told apart by size."""
    return F.when(number > 1e12, number.cast("bigint")).otherwise((number.cast("double") * 1000).cast("bigint"))


def report_date(ts_ms: Column, zone: str = "UTC") -> Column:
    """YYYY-MM-DD in the report's zone, as text."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone), "yyyy-MM-dd")


def rfc3339(ts_ms: Column) -> Column:
    """UTC with three decimals and Z."""
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_of(day: Column) -> Column:
    return F.substring(day, 1, 7)


def week_start(day: Column, start: str = "monday") -> Column:
    """First day of the week of a YYYY-MM-DD text; text that is no date stays as it is."""
    d = day.try_cast("date")
    shifted = F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - WEEKDAYS.index(start), F.lit(7)))
    return F.coalesce(F.date_format(shifted, "yyyy-MM-dd"), day)


def normal_bound(bound: str) -> str:
    """YYYY-MM-DD or YYYYMMDD as YYYYMMDD; only real dates pass."""
    if not re.fullmatch(r"\d{8}|\d{4}-\d{2}-\d{2}", bound):
        raise ValueError(f"not a date: {bound}")
    text = bound.replace("-", "")
    date(int(text[:4]), int(text[4:6]), int(text[6:]))
    return text


def in_dates(day: Column, since: str | None, until: str | None) -> Column:
    """Inclusive at both ends; bounds are compared as text, so a prefix such as 2026 works too."""
    compact = F.regexp_replace(day, "-", "")
    keep = F.lit(True)
    if since:
        keep = keep & (compact >= since.replace("-", ""))
    if until:
        keep = keep & (compact <= until.replace("-", ""))
    return keep


def in_instants(ts_ms: Column, since: str | None, until: str | None, zone: str = "UTC") -> Column:
    """From the start of since to the end of until in the zone, half open, right across clock changes."""
    keep = F.lit(True)
    if since:
        keep = keep & (ts_ms >= F.unix_millis(F.to_utc_timestamp(F.lit(since).cast("timestamp_ntz").cast("timestamp"), zone)))
    if until:
        after = (date.fromisoformat(until) + timedelta(days=1)).isoformat()
        keep = keep & (ts_ms < F.unix_millis(F.to_utc_timestamp(F.lit(after).cast("timestamp_ntz").cast("timestamp"), zone)))
    return keep


def last_periods(today: date, unit: str, n: int, start: str = "monday") -> str:
    """First day of the n most recent days, weeks or months, today's included."""
    if n < 1:
        raise ValueError("needs at least one period")
    if unit == "day":
        return (today - timedelta(days=n - 1)).isoformat()
    if unit == "week":
        shift = (today.isoweekday() % 7 - WEEKDAYS.index(start)) % 7
        return (today - timedelta(days=shift + 7 * (n - 1))).isoformat()
    month = today.year * 12 + today.month - n
    return date(month // 12, month % 12 + 1, 1).isoformat()
