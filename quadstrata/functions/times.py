"""Layer ids are unix seconds, in UTC whatever the session's zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_unix(moment: datetime) -> int:
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def from_unix(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def start_of_week(moment: datetime) -> datetime:
    """Monday, midnight."""
    return moment.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=moment.weekday())


def unix_of(ts: Column) -> Column:
    """Seconds of a zone-less timestamp, read as UTC."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def week_of(ts: Column) -> Column:
    """Monday of a zone-less timestamp's week, as a date."""
    return F.date_sub(ts.cast("date"), F.weekday(ts.cast("date")))
