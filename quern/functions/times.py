"""Time predicates; what counts as now is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    """A time without a zone."""
    return F.lit(text).cast("timestamp_ntz")


def later(at: Column, hours: float) -> Column:
    return at + F.make_dt_interval(secs=F.lit(hours * 3600))


def overdue(due: Column, completed: Column, now: Column) -> Column:
    return due.isNotNull() & ~F.coalesce(completed, F.lit(False)) & (due < now)


def due_before(due: Column, now: Column, hours: float) -> Column:
    """Due within the window or overdue already."""
    return F.coalesce(due < later(now, hours), F.lit(False))


def due_between(due: Column, now: Column, hours: float) -> Column:
    """Due after now and before the window's end."""
    return F.coalesce((due > now) & (due < later(now, hours)), F.lit(False))


def due_within_hours(due: Column, now: Column, hours: int) -> Column:
    """0 to `hours` whole hours from now."""
    left = whole_hours(now, due)
    return F.coalesce((due >= now) & (left <= hours), F.lit(False))


def same_day(a: Column, b: Column) -> Column:
    return F.coalesce(F.to_date(a) == F.to_date(b), F.lit(False))


def whole_hours(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def remaining_seconds(end: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", now, end))


def stale(checked: Column, now: Column, hours: float) -> Column:
    """Never checked, or not within the last `hours`."""
    return checked.isNull() | (checked < later(now, -hours))


def backoff_seconds(attempt: Column, initial: float = 1.0) -> Column:
    return initial * F.pow(F.lit(2.0), attempt - 1)


#: Retry presets (fixed values): attempts, seconds before the first retry.
RETRIES = {"quick": (3, 1.0), "standard": (3, 2.0), "slow": (5, 5.0), "critical": (10, 1.0)}


def jittered(delay: Column, *key: Column) -> Column:
    """A delay times a factor of 0.5 to 1 that depends on `key`, so that it is the same when run again."""
    return delay * (0.5 + F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / 2_000_000)


def retry_schedule(name: str) -> Column:
    """The seconds before each retry of a preset, as an array."""
    attempts, initial = RETRIES[name]
    return F.transform(F.sequence(F.lit(1), F.lit(attempts - 1)), lambda n: backoff_seconds(n, initial))


def to_iso(at: Column) -> Column:
    """ISO 8601 with milliseconds, or microseconds where there are any."""
    whole = F.pmod(F.date_format(at, "SSSSSS").cast("int"), F.lit(1000)) == 0
    return F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def from_iso(text: Column) -> Column:
    """The time without a zone that an ISO 8601 text states; null where it states none."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")
