"""Clock, time windows and elapsed time. The session time zone is expected to be UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def instant(as_of: datetime | str | Column | None = None) -> Column:
    """A moment as a timestamp column; naive values are UTC, ``None`` is the query's clock."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return F.lit(as_of.astimezone(timezone.utc).isoformat()).cast("timestamp")


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def day_range(as_of, days: int) -> tuple[Column, Column]:
    """The last ``days`` calendar days, up to tomorrow's midnight: ``[since, until)``."""
    until = F.date_trunc("day", instant(as_of)) + _days(1)
    return until - _days(days), until


def hour_range(as_of, hours: int) -> tuple[Column, Column]:
    """The last ``hours`` hours up to now: ``[since, until)``; the first bucket is partial."""
    until = instant(as_of)
    return until - F.make_dt_interval(hours=F.lit(hours)), until


def days_before(as_of, days: int) -> Column:
    return instant(as_of) - _days(days)


def day_of(ts: str | Column) -> Column:
    return F.date_trunc("day", ts)


def hour_of(ts: str | Column) -> Column:
    return F.date_trunc("hour", ts)


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed microseconds as a long, so that the arithmetic on it is exact."""
    return F.unix_micros(end) - F.unix_micros(start)


def exact_average(micros: Column, unit: int) -> Column:
    """Average of elapsed microseconds, in ``unit``; NULLs are left out.

    The sum is a decimal: a long of microseconds would overflow at about 10^8 rows of a day.
    """
    total = F.sum(micros.cast("decimal(18,0)")).cast("double")
    return total / (F.count(micros) * F.lit(float(unit)))


def rounded(number: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(number + F.lit(0.5)).cast("long")


def age_text(minutes: Column) -> Column:
    """``5m``, or ``2h 30m`` above an hour; the hours are rounded, not cut off."""
    return F.when(
        minutes > 60,
        F.concat(rounded(minutes / 60), F.lit("h "), minutes % 60, F.lit("m")),
    ).otherwise(F.concat(minutes, F.lit("m")))


def state_slug(state: str | Column) -> Column:
    return F.regexp_replace(state, r"\s+", "-")


def hour_label(hour: str | Column) -> Column:
    return F.concat(F.hour(hour), F.lit(":00"))
