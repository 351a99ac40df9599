"""Average and maximum per key and event-time window.

The same functions serve a table and a stream. Windows are half-open, aligned to the epoch in UTC, and exist only where
they have a row. Rows need ``event_time``, ``location_id`` and ``temperature``; results are
``location_id, window_start, temperature``.

Plans
-----
* stream, tumbling or gapped (slide >= size): one aggregation on (key, window); a row belongs to at most one window, or the
  state store needs the rows expanded.
* sliding window over a table: a row belongs to size/slide windows, and expanding the rows would send that many copies
  through the shuffle. Instead rows that share all their windows are first reduced to one *pane* (one per slide, or two where
  slide does not divide size) with map-side partial aggregation, so a hot key collapses before it is moved, and its panes
  spread over all tasks. Panes are then moved once, by key and time block; a pane near a block edge goes to every block that
  holds one of its windows, usually one.
* sums inside a block: a pane is added where its first window starts and taken away behind its last one. The running sum of
  these two changes per pane is every window's sum, so work follows panes and results, not their number of windows.
* maxima inside a block cannot be taken away again. They change where a pane comes or goes, so at each such place the maximum is
  taken over the panes that began no longer ago than a pane lasts; windows in between repeat it. Tasks sort two or three rows
  per pane and hash none.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions.decimals import limb_count, limbs, with_mean
from winfleet.functions.times import interval_text, micros

DEFAULT_SIZE = timedelta(minutes=60)
DEFAULT_SLIDE = timedelta(minutes=5)

# A block of panes spans this many window sizes: about one pane row in that number is copied to a second block.
BLOCK_SIZES = 24

def average_temperature(
    rows: DataFrame, size: timedelta = DEFAULT_SIZE, slide: timedelta = DEFAULT_SLIDE, panes: bool | None = None
) -> DataFrame:
    """Average per key and window with two decimals, ties toward zero, for decimals of any precision.

    Sums are exact: digits are summed in limbs of 64 bits. The result has eighteen digits, or as many as the whole part of the
    input needs; averages of 10^36 or more do not fit and fail. ``panes=None`` picks the plan as described above."""
    kind = _decimal(rows)
    names = _limb_names(kind)
    totals = _aggregate(average_readings(rows), size, slide, panes, *average_sums(kind), sums=[*names, "n"])
    return average_of(totals, kind)


def average_readings(rows: DataFrame) -> DataFrame:
    """Rows with the limbs of their temperature."""
    kind = _decimal(rows)
    digits = [limb.alias(name) for name, limb in zip(_limb_names(kind), limbs(F.col("temperature"), kind))]
    return rows.where("temperature IS NOT NULL").select("location_id", "event_time", *digits)


def average_sums(kind: T.DecimalType) -> tuple[list[Column], list[Column]]:
    """Aggregates of readings, and aggregates of those."""
    sums = [F.sum(name).alias(name) for name in _limb_names(kind)]
    return [*sums, F.count("*").alias("n")], [*sums, F.sum("n").alias("n")]


def average_of(totals: DataFrame, kind: T.DecimalType) -> DataFrame:
    return with_mean(totals, _limb_names(kind), "n", kind, "temperature").select("location_id", "window_start", "temperature")


def _limb_names(kind: T.DecimalType) -> list[str]:
    return [f"limb{k}" for k in range(limb_count(kind))]


def _decimal(rows: DataFrame) -> T.DecimalType:
    kind = rows.schema["temperature"].dataType
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"temperature must be a decimal, not {kind.simpleString()}")
    return kind


def maximum_temperature(
    rows: DataFrame, size: timedelta = DEFAULT_SIZE, slide: timedelta = DEFAULT_SLIDE, panes: bool | None = None
) -> DataFrame:
    """Maximum per key and window, with the scale of the input."""
    highest = F.max("temperature").alias("temperature")
    readings = rows.where("temperature IS NOT NULL").select("location_id", "event_time", "temperature")
    return _aggregate(readings, size, slide, panes, partial=[highest], merge=[highest]).select(
        "location_id", "window_start", "temperature"
    )


def _aggregate(
    rows: DataFrame,
    size: timedelta,
    slide: timedelta,
    panes: bool | None,
    partial: list[Column],
    merge: list[Column],
    sums: list[str] | None = None,
) -> DataFrame:
    """``sums`` names the aggregates if all of them are sums of integers and the last one counts rows."""
    if size <= timedelta(0) or slide <= timedelta(0):
        raise ValueError("size and slide must be positive")
    if panes is None:
        panes = not rows.isStreaming
    if panes and slide < size:
        return windows_of_panes(with_spans(rows, size, slide).groupBy("location_id", "first", "last").agg(*partial), size, slide, merge, sums)
    if slide > size:
        # F.window rejects gaps between windows; the tumbling window of length slide starts where the gapped one does.
        slots = rows.withColumn("window", F.window("event_time", interval_text(slide)))
        rows = slots.where(F.col("event_time") < F.col("window.start") + F.lit(size))
        grouped = rows.groupBy("location_id", "window")
    else:
        grouped = rows.groupBy("location_id", F.window("event_time", interval_text(size), interval_text(slide)))
    return grouped.agg(*partial).withColumn("window_start", F.col("window.start"))


def with_spans(rows: DataFrame, size: timedelta, slide: timedelta) -> DataFrame:
    """Add ``first`` and ``last``, the starts of the first and the last window that holds a row; rows of no window go."""
    spans = rows.withColumn("last", _floor(F.col("event_time"), slide))
    if micros(size) % micros(slide):
        return spans.withColumn("first", _floor(F.col("event_time") - F.lit(size), slide)).withColumn("first", F.col("first") + F.lit(slide)).where("first <= last")
    return spans.withColumn("first", F.col("last") - F.lit(size - slide))


def windows_of_panes(
    panes: DataFrame,
    size: timedelta,
    slide: timedelta,
    merge: list[Column],
    sums: list[str] | None = None,
    oldest: Column | None = None,
    newest: Column | None = None,
) -> DataFrame:
    """Windows of panes: rows of aggregates with their ``location_id`` and the ``first`` and ``last`` window they belong to.

    Aggregates other than ``sums`` are maxima. ``oldest`` and ``newest`` are the starts of the first and the last window wanted.
    """
    block = slide * (BLOCK_SIZES * -(-size // slide))
    # Every step is a select of its own because a select takes a single window expression.
    spans = panes.withColumn("low", _floor(F.col("first"), block))
    spans = spans.withColumn("high", _floor(F.col("last"), block))
    copies = spans.withColumn("block", F.explode(F.sequence("low", "high", F.lit(block))))
    moved = copies.repartition("location_id", "block")
    running = _running_maxima(moved, size, slide, block) if sums is None else _running_sums(moved, slide, block, merge, sums)
    begin, end = F.col("at"), F.coalesce("until", F.col("block") + F.lit(block))
    begin = begin if oldest is None else F.greatest(begin, oldest)
    end = end if newest is None else F.least(end, newest + F.lit(slide))
    running = running.withColumn("until", end).withColumn("at", begin).where("at < until")
    return running.withColumn("window_start", F.explode(F.sequence("at", F.col("until") - F.lit(slide), F.lit(slide))))


def _running_sums(moved: DataFrame, slide: timedelta, block: timedelta, merge: list[Column], sums: list[str]) -> DataFrame:
    """Sums of the windows from ``at`` up to ``until``, null for the end of the block."""
    comes = F.struct(F.greatest("first", "block").alias("at"), *sums)
    goes = F.struct((F.col("last") + F.lit(slide)).alias("at"), *[(-F.col(name)).alias(name) for name in sums])
    changes = moved.select("location_id", "block", F.explode(F.array(comes, goes)).alias("change")).select("location_id", "block", "change.*")
    changes = changes.where(F.col("at") < F.col("block") + F.lit(block)).groupBy("location_id", "block", "at").agg(*merge)
    in_order = Window.partitionBy("location_id", "block").orderBy("at")
    running = changes.select("location_id", "block", "at", F.lead("at").over(in_order).alias("until"), *[F.sum(name).over(in_order).alias(name) for name in sums])
    return running.where(F.col(sums[-1]) > 0)


def _running_maxima(moved: DataFrame, size: timedelta, slide: timedelta, block: timedelta) -> DataFrame:
    """Maxima of the windows from ``at`` up to ``until``, null for the end of the block.

    Panes last ``reach`` from their first to their last window, or one slide less where slide does not divide size.
    """
    names = [name for name in moved.columns if name not in ("location_id", "first", "last", "low", "high", "block")]
    kinds = {name: moved.schema[name].dataType for name in names}
    reach = micros(slide) * (-(-micros(size) // micros(slide)) - 1)
    reaches = [reach, reach - micros(slide)] if micros(size) % micros(slide) else [reach]
    lasts = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))

    def change(at: Column, comes: bool) -> Column:
        values = [(F.when(lasts == r, F.col(n)) if comes else F.lit(None).cast(kinds[n])).alias(f"{n}_{k}") for n in names for k, r in enumerate(reaches)]
        return F.struct(at.alias("at"), *values)

    comes, goes = change(F.col("first"), True), change(F.col("last") + F.lit(slide), False)
    inside = F.array(comes, goes)
    changes = F.when(F.col("first") < F.col("block"), F.array(comes, goes, change(F.col("block"), False))).otherwise(inside)
    changes = moved.select("location_id", "block", F.explode(changes).alias("change")).select("location_id", "block", "change.*")
    changes = changes.where(F.col("at") < F.col("block") + F.lit(block)).withColumn("order", F.unix_micros(F.col("at").cast("timestamp")))
    in_order = Window.partitionBy("location_id", "block").orderBy("order")
    highest = [F.max(f"{n}_{k}").over(in_order.rangeBetween(-r, 0)).alias(f"{n}_{k}") for n in names for k, r in enumerate(reaches)]
    running = changes.select("location_id", "block", "at", F.lead("at").over(in_order).alias("until"), *highest)
    maxima = [(F.greatest(*parts) if len(parts) > 1 else parts[0]).alias(n) for n in names if (parts := [F.col(f"{n}_{k}") for k in range(len(reaches))])]
    running = running.select("location_id", "block", "at", "until", *maxima)
    return running.where(F.col("at") >= F.col("block")).where(F.coalesce(*names).isNotNull())


def _floor(column: Column, length: timedelta) -> Column:
    return F.window(column, interval_text(length)).getField("start")
