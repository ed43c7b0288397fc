"""Time without a session time zone: instants are microseconds since 1970 of a timestamp without zone."""

from __future__ import annotations

import math
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz; exact at any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def from_micros(us: Column) -> Column:
    """timestamp_ntz of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("timestamp_ntz")


def whole_seconds(us: Column) -> Column:
    """Second that an instant lies in (floor, before 1970 too): differences count second boundaries."""
    return ((us - F.pmod(us, F.lit(1_000_000))) / 1_000_000).cast("long")


def shifted(seconds: Column, origin: str = "2017-12-01 00:00:00") -> Column:
    """timestamp_ntz ``seconds`` after an origin."""
    return F.timestamp_add("SECOND", seconds.cast("long"), F.lit(origin).cast("timestamp_ntz")).cast("timestamp_ntz")


def parse_date(value: object, name: str) -> date:
    """A date, or text in the form YYYY-MM-DD exactly; a datetime is refused."""
    if isinstance(value, datetime):
        raise ValueError(f"{name} must be a date, not a datetime")
    if isinstance(value, date):
        return value
    try:
        parsed = date.fromisoformat(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        parsed = None
    if parsed is None or parsed.isoformat() != value:
        raise ValueError(f"{name} must look like YYYY-MM-DD: {value!r}")
    return parsed


def epoch_micros(value: object) -> int:
    """Microseconds of a datetime (naive ones are UTC), ISO text or number of seconds; bool, NaN and infinity are refused."""
    if isinstance(value, bool):
        raise ValueError("an instant is not a bool")
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            raise ValueError(f"not an ISO instant: {value!r}") from None
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=UTC)
        return (aware - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("an instant must be finite")
        return round(value * 1_000_000)
    raise ValueError(f"not an instant: {value!r}")
