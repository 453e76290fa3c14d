"""Time expressions. Instants are wall-clock seconds (long), so no time zone ever shifts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 on the wall clock of a TIMESTAMP_NTZ (or timestamp text) column."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def masked_instant(s: Column) -> Column:
    """Wall-clock seconds of an ISO text; a closing offset or Z is dropped, not applied."""
    return wall_seconds(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " ")).cast("timestamp_ntz"))


def day_of(t: Column) -> Column:
    """Day number of wall-clock seconds."""
    return F.floor(t / DAY)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up (also for negative numbers)."""
    return F.floor(x + 0.5)


def clock_minutes(s: Column) -> Column:
    """Minutes of ``HH:MM``; null if malformed."""
    return F.when(s.rlike(r"^\s*[0-9]{1,2}:[0-9]{1,2}"), F.regexp_extract(s, r"([0-9]+):([0-9]+)", 1).try_cast("int") * 60 + F.regexp_extract(s, r"([0-9]+):([0-9]+)", 2).try_cast("int"))


def clock_gap(a: Column, b: Column) -> Column:
    """Minutes from ``HH:MM`` a to b, over midnight if b is earlier; null if one is malformed."""
    d = clock_minutes(b) - clock_minutes(a)
    return F.when(d < 0, d + 1440).otherwise(d)


def shift_of(s: Column) -> Column:
    """Part of the day of ``HH:MM``: night before 6, morning before 12, afternoon before 18, then evening."""
    hour = F.floor(clock_minutes(s) / 60)
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").when(hour.isNotNull(), "evening")


def clock(t: Column) -> Column:
    """``HH:MM`` of wall-clock seconds."""
    m = F.floor(F.pmod(t, F.lit(DAY)) / 60)
    return F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def parse_duration(s: Column) -> Column:
    """Seconds of ``0D HH:MM:SS``; null if malformed."""
    pattern = r"^([0-9]+)D ([0-9]+):([0-9]+):([0-9]+)$"
    part = lambda i: F.regexp_extract(s, pattern, i).try_cast("long")
    return part(1) * DAY + part(2) * 3600 + part(3) * 60 + part(4)


def format_minutes(m: Column) -> Column:
    """``HhMMmin`` of whole minutes."""
    return F.concat(F.floor(m / 60).cast("string"), F.lit("h"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("min"))


def parse_minutes(s: Column) -> Column:
    """Minutes of ``10h38min``; null if malformed."""
    return F.regexp_extract(s, r"^([0-9]+)h([0-9]+)min$", 1).try_cast("int") * 60 + F.regexp_extract(s, r"^([0-9]+)h([0-9]+)min$", 2).try_cast("int")


def serial_date(n: Column) -> Column:
    """Date of a spreadsheet's day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def dmy_date(s: Column) -> Column:
    """Date of ``dd/MM/yyyy``; null if malformed."""
    return F.try_to_timestamp(s, F.lit("dd/MM/yyyy")).cast("date")


def next_working_day(d: Column) -> Column:
    """The day after, or the Monday after a Saturday: only Sundays are skipped."""
    after = F.date_add(d, 1)
    return F.when(F.dayofweek(after) == 1, F.date_add(after, 1)).otherwise(after)


def period_bounds(period: str, ref: Column) -> tuple[Column, Column]:
    """First and last date of the day, week (from Monday), month or year that holds ``ref``."""
    if period == "day":
        return ref, ref
    first = F.to_date(F.date_trunc({"week": "week", "month": "month", "year": "year"}[period], ref))
    last = {"week": F.date_add(first, 6), "month": F.last_day(first), "year": F.date_sub(F.add_months(first, 12), 1)}[period]
    return first, last


def previous_bounds(period: str, ref: Column) -> tuple[Column, Column]:
    """Bounds of the calendar period before the one of ``ref``."""
    before = {"day": F.date_sub(ref, 1), "week": F.date_sub(ref, 7), "month": F.add_months(F.to_date(F.date_trunc("month", ref)), -1), "year": F.add_months(F.to_date(F.date_trunc("year", ref)), -12)}
    return period_bounds(period, before[period])


def previous_span(first: Column, last: Column) -> tuple[Column, Column]:
    """The equally long span just before [first, last]."""
    days = F.datediff(last, first) + 1
    return F.date_add(first, -days), F.date_add(first, -1)
