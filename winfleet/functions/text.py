"""Text lines of sensor rows and of window rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winfleet.functions.times import format_time


def _joined(separator: str, missing: str, columns: list[Column]) -> Column:
    # concat_ws skips nulls, which would shift the columns behind a missing value.
    return F.concat_ws(separator, *[F.coalesce(column.cast("string"), F.lit(missing)) for column in columns])


def sensor_line(time: Column, event_id: Column, location_id: Column, temperature: Column) -> Column:
    """``time,id,key,value``, without header or quoting."""
    return _joined(",", "", [format_time(time), event_id, location_id, temperature])


def window_line(start: Column, location_id: Column, temperature: Column) -> Column:
    """``time,key,value``, the time being the start of the window."""
    return _joined(",", "", [format_time(start), location_id, temperature])


def sensor_display(time: Column, event_id: Column, location_id: Column, temperature: Column) -> Column:
    return _joined(", ", "null", [format_time(time), event_id, location_id, temperature])


def window_display(start: Column, location_id: Column, temperature: Column) -> Column:
    return _joined(", ", "null", [format_time(start), location_id, temperature])
