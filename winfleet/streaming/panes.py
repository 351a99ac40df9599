"""Open panes as the state of a stream of sliding windows.

A row in a dozen windows would be a dozen rows of state. Rows that share all their windows are one pane instead, a row of state per
key and pane, and windows are made of panes only when the watermark closes them.

Spark holds the panes: an aggregation whose key ends where the pane's last window does, so rows of closed windows alone are late, and
panes leave with their last window. A micro-batch closes the windows that end after the watermark of the one before it and not
after its own. Its own rows are too late for these, so they follow from the state that the micro-batch before has left, which is read
by Spark's state data source; a micro-batch that runs again finds the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions.times import interval_text, micros
from winfleet.operators.windows import average_of, average_readings, average_sums, windows_of_panes, with_spans
from winfleet.streaming.savepoints import state_at, watermark_of


@dataclass(frozen=True)
class Measure:
    """What is known of a window: how rows are prepared and combined, how panes are, and how a window's row follows."""

    readings: Callable[[DataFrame], DataFrame]
    partial: list[Column]
    merge: list[Column]
    sums: list[str] | None
    result: Callable[[DataFrame], DataFrame]


def average_measure(rows: DataFrame) -> Measure:
    kind = rows.schema["temperature"].dataType
    partial, merge = average_sums(kind)
    names = [name for name in average_readings(rows).columns if name.startswith("limb")]
    return Measure(average_readings, partial, merge, [*names, "n"], lambda totals: average_of(totals, kind))


def maximum_measure(rows: DataFrame) -> Measure:
    highest = [F.max("temperature").alias("temperature")]
    columns = ["location_id", "window_start", "temperature"]
    return Measure(lambda r: r.where("temperature IS NOT NULL").select("location_id", "event_time", "temperature"), highest, highest, None, lambda totals: totals.select(*columns))


def windows_between(panes: DataFrame, before: int | None, clock: int | None, measure: Measure, size: timedelta, slide: timedelta) -> DataFrame:
    """The windows of panes that end after ``before`` and not after ``clock``, in microseconds; without a clock none do."""
    if clock is None:
        return measure.result(windows_of_panes(panes.where("false"), size, slide, measure.merge, measure.sums))
    # Windows that end in (before, clock] start in (before - size, clock - size].
    kind = panes.schema["first"].dataType
    grid = micros(slide)
    newest_start = F.timestamp_micros(F.lit((clock - micros(size)) // grid * grid)).cast(kind)
    oldest_start = None
    panes = panes.where(F.col("first") <= newest_start)
    if before is not None:
        oldest_start = F.timestamp_micros(F.lit(((before - micros(size)) // grid + 1) * grid)).cast(kind)
        panes = panes.where(F.col("last") >= oldest_start)
    return measure.result(windows_of_panes(panes, size, slide, measure.merge, measure.sums, oldest_start, newest_start))


def open_panes(rows: DataFrame, measure: Measure, size: timedelta, slide: timedelta) -> DataFrame:
    """The panes of a stream of rows with a watermark, by ``location_id``, their last ``window`` and the start ``first`` of their first."""
    # Of the windows of a row its last one is kept: Spark has to see by which time a pane is closed.
    spans = with_spans(measure.readings(rows), size, slide)
    last = spans.withColumn("window", F.window("event_time", interval_text(size), interval_text(slide))).where("window.start = last")
    return last.groupBy("location_id", "window", "first").agg(*measure.partial)


def closed_by(spark: SparkSession, checkpoint: str, batch: int, panes: DataFrame, measure: Measure, size: timedelta, slide: timedelta) -> DataFrame:
    """The windows that micro-batch ``batch`` of a query of ``open_panes`` closes; ``panes`` is its result."""
    names = [c for c in panes.columns if c not in ("location_id", "window", "first")]
    held = T.StructType([T.StructField(name, panes.schema[name].dataType) for name in names])
    kinds = [panes.schema["location_id"], panes.schema["first"], T.StructField("last", panes.schema["first"].dataType), *held]
    before, clock = (watermark_of(checkpoint, b) if b >= 0 else 0 for b in (batch - 1, batch))
    if clock <= before:
        return windows_between(spark.createDataFrame([], T.StructType(kinds)), None, None, measure, size, slide)
    state = state_at(spark, checkpoint, batch - 1)
    # Spark names the values of its state after its functions; they have the order of the aggregates.
    state = state.select("key.*", F.col("value").cast(held).alias("value"))
    state = state.select("location_id", "first", F.col("window.start").alias("last"), "value.*")
    return windows_between(state, before * 1000, clock * 1000, measure, size, slide)
