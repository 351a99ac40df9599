"""Time text, hour buckets and elapsed seconds. The session must be in UTC (``session.use_utc``)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text formats of event times and of output buckets.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
BUCKET_FORMAT = "yyyy-MM-dd--HH"


def format_time(time: Column) -> Column:
    return F.date_format(time, TIME_FORMAT)


def parse_time(text: Column) -> Column:
    """The inverse of ``format_time``, as epoch milliseconds."""
    return F.unix_millis(F.to_timestamp(text, TIME_FORMAT))


def time_from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def epoch_millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def hour_bucket(time: Column) -> Column:
    return F.date_format(time, BUCKET_FORMAT)


def seconds_since(time: Column, now: Column) -> Column:
    """Whole seconds from ``time`` to ``now``; a missing time reads as the epoch."""
    elapsed = epoch_millis(now) - F.coalesce(epoch_millis(time), F.lit(0))
    return (elapsed / 1000).cast("bigint")


def micros(length: timedelta) -> int:
    """A duration in microseconds, the resolution of Spark's timestamps."""
    return length // timedelta(microseconds=1)


def interval_text(length: timedelta) -> str:
    """A duration as text for ``F.window`` and ``withWatermark``."""
    return f"{micros(length)} microseconds"
