"""Filters and ordered classifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import first_match
from waymark.functions.time import DAY


def matching(df: DataFrame, among: Mapping[str, Sequence] | None = None, between: Mapping[str, tuple] | None = None) -> DataFrame:
    """Conjunction of membership and range filters; an absent or empty one holds for all rows."""
    for column, values in (among or {}).items():
        df = df.where(F.col(column).isin(list(values))) if values else df
    for column, (low, high) in (between or {}).items():
        df = df if low is None else df.where(F.col(column) >= low)
        df = df if high is None else df.where(F.col(column) <= high)
    return df


def permitted(asked: Column, allowed: Column) -> Column:
    """The asked names that are allowed; all allowed ones if none is asked."""
    return F.when(F.size(asked) > 0, F.array_intersect(asked, allowed)).otherwise(allowed)


def valid_on(day: Column, first: Column, last: Column) -> Column:
    """first <= day <= last, an unknown end being open."""
    return (first <= day) & (last.isNull() | (last >= day))


def night_stay(arrive: Column, leave: Column, long_s: int = 2 * 3600) -> Column:
    """Arrives before 3, stays over ``long_s`` and leaves before 6 or is still there."""
    hour = lambda t: F.floor(F.pmod(t, F.lit(DAY)) / 3600)
    return (hour(arrive) < 3) & (leave.isNull() | ((leave - arrive > long_s) & (hour(leave) < 6)))


def stop_class(at_base: Column, at_store: Column, on_road: Column, seconds: Column) -> Column:
    """STORE in a store's fence; BASE if it lasts over 900 s at base; OUTSIDE from 600 s on elsewhere; else FAKE_EXIT."""
    return first_match(
        [
            (at_store, F.lit("STORE")),
            (at_base & (seconds > 900), F.lit("BASE")),
            (at_base, F.lit("FAKE_EXIT")),
            (on_road & (seconds < 600), F.lit("FAKE_EXIT")),
            (on_road, F.lit("OUTSIDE")),
        ],
        "STORE",
    )


def live_state(delivered: Column, known: Column, left_base: Column) -> Column:
    """State of a plan line while the day runs."""
    return first_match([(delivered, F.lit("delivered")), (~known, F.lit("no_tracker")), (left_base, F.lit("on_route"))], "waiting")


def tracker_state(last_seen: Column, reference_day: Column) -> Column:
    """No known spelling: untracked; seen on the reference day: tracked; else stale."""
    return F.when(last_seen.isNull(), "untracked").when(last_seen == reference_day, "tracked").otherwise("stale")


def pending_cause(never_left: Column, no_signal: Column, in_gap: Column, near_m: Column) -> Column:
    """Cause of a pending row from joined evidence, strongest first."""
    return first_match(
        [
            (no_signal, F.lit("no_signal")),
            (never_left, F.lit("never_left")),
            (in_gap, F.lit("signal_gap")),
            (near_m <= 500, F.lit("passed_by")),
            (near_m <= 2000, F.lit("near")),
        ],
        "did_not_go",
    )


def blocking(warnings: DataFrame, always: Sequence[str], outage: str, except_: str, partial: str, share: float) -> DataFrame:
    """Warnings that stop a publication: codes in ``always``, outages of any source but one, partial results above a share."""
    code = F.col("code")
    return warnings.where(code.isin(list(always)) | ((code == outage) & (F.col("source") != except_)) | ((code == partial) & (F.col("share") > share)))
