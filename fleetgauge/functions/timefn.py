"""Time columns. The session time zone has to be UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_utc(value: datetime) -> datetime:
    """The moment with its zone; one without a zone is meant in UTC."""
    return value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)


def moment(value: datetime) -> Column:
    """A fixed time as a column. Without this a naive value would mean local time."""
    return F.lit(in_utc(value))


def to_ms(ts: Column) -> Column:
    """A timestamp cut to milliseconds, the grain metrics are stored at."""
    return F.timestamp_millis(F.unix_millis(ts))


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds, truncated."""
    return F.unix_millis(ts)


def event_time(text: Column) -> Column:
    """ISO event time, with or without Z, as UTC; a missing or bad one means now."""
    return F.coalesce(F.try_to_timestamp(F.rtrim(text)), F.current_timestamp())


def store_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss[.f{1,9}]` as a UTC timestamp; NULL when unreadable."""
    micros = F.regexp_replace(text, r"(\.\d{6})\d+$", "$1")
    return F.try_to_timestamp(F.regexp_replace(micros, r"\.$", ""))


def iso_from_ms(ms: Column) -> Column:
    """Epoch milliseconds as ISO text with offset; the fraction shows only when not zero."""
    ts = F.timestamp_millis(ms)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def duration_sec(start: Column, end: Column) -> Column:
    """Seconds between two timestamps; NULL while one is missing."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def digest_window(now: datetime, hours: int) -> tuple[datetime, datetime]:
    """Start and end of the reported period."""
    return now - timedelta(hours=hours), now
