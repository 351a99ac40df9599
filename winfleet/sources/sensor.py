"""Sensor rows from tables, from file streams and from a distributed generator."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions.keys import repeatable_id, uuid_key
from winfleet.schemas import TEMPERATURE


def sensor_rows(
    events: DataFrame,
    event_id: str = "event_id",
    event_time: str = "ts",
    location_id: str = "user_id",
    temperature: str = "value",
    kind: T.DecimalType | None = None,
) -> DataFrame:
    """Project any event table or stream onto the four sensor columns.

    Decimals keep their type unless ``kind`` says otherwise, other numbers become TEMPERATURE: eighteen digits and six
    decimals. Epoch milliseconds become timestamps, and a stream's zone-less times become timestamps because a watermark needs them.
    """
    time = F.col(event_time)
    time_type = events.schema[event_time].dataType
    if isinstance(time_type, (T.LongType, T.IntegerType)):
        time = F.timestamp_millis(time)
    elif events.isStreaming or isinstance(time_type, T.StringType):
        time = time.cast("timestamp")
    if kind is None:
        given = events.schema[temperature].dataType
        kind = given if isinstance(given, T.DecimalType) else TEMPERATURE
    return events.select(
        F.col(event_id).cast("string").alias("event_id"),
        time.alias("event_time"),
        F.col(location_id).alias("location_id"),
        F.col(temperature).cast(kind).alias("temperature"),
    )


def event_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream. ``files_per_trigger`` bounds what one micro-batch reads and
    ``pattern`` selects file names."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The table ``name`` as a stream, be it one file or a folder of part files.

    A file source wants a folder or a pattern; the pattern fits the name alone, and Spark lists what it finds there.
    """
    return event_stream(spark, f"{folder}/{name}.parque[t]", schema, files_per_trigger)


def with_watermark(rows: DataFrame, lateness: timedelta = timedelta(minutes=1)) -> DataFrame:
    """Bound how far events may be out of order. A window closes once the largest event time is ``lateness`` past its end.

    Within one source idle partitions never hold the watermark back. Over a union of sources Spark takes the slowest
    one's watermark, so an idle source blocks output; ``spark.sql.streaming.multipleWatermarkPolicy=max`` lifts that at
    the price of dropping the slower source's rows.
    """
    return rows.withWatermark("event_time", f"{lateness // timedelta(milliseconds=1)} milliseconds")


def generate_table(spark: SparkSession, limit: int, **options: object) -> DataFrame:
    """Exactly ``limit`` synthetic sensor rows; see ``generated``."""
    return generated(spark.range(limit), "id", **options)


def generate_stream(spark: SparkSession, rows_per_second: int = 100, **options: object) -> DataFrame:
    """Synthetic sensor rows at a steady rate; see ``generated``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return generated(ticks, "value", **options)


def generated(
    numbers: DataFrame,
    index: str,
    keys: int = 1,
    delays: list[int] | None = None,
    delay_interval: int = 1000,
    start: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc),
    seed: str = "sensor",
) -> DataFrame:
    """Turn the numbers 0, 1, 2, ... of a column into synthetic sensor rows.

    Row i belongs to key ``i mod keys`` and is that key's event number ``i div keys``. Delays between a key's events cycle
    through ``delays`` (milliseconds), moving on every ``delay_interval`` milliseconds. The event's time is a closed formula
    of its number and its id and value are hashes of its index, so rows need no neighbours, no shuffle and no shared clock,
    and a recomputed task repeats its rows. Values are uniform in [20, 30).
    """
    delays = delays or [100, 200]
    if keys < 1 or delay_interval < 1 or min(delays) < 1:
        raise ValueError("keys, delay_interval and delays must be positive")
    number = F.col(index).cast("bigint")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")))
    fraction = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    offset = _offset_millis(F.floor(number / keys), delays, delay_interval)
    return numbers.select(
        repeatable_id(F.concat(F.lit(f"{seed}-id:"), number.cast("string"))).alias("event_id"),
        F.timestamp_millis(F.lit(int(start.timestamp() * 1000)) + offset).alias("event_time"),
        uuid_key(F.pmod(number, F.lit(keys))).alias("location_id"),
        (F.lit(20) + fraction * F.lit(10) / F.lit(2**32)).cast(T.DecimalType(8, 6)).alias("temperature"),
    )


def _offset_millis(number: Column, delays: list[int], delay_interval: int) -> Column:
    """Milliseconds from the start to a key's event of the given number.

    A phase holds the multiples of its delay below the interval; a cycle is one phase per delay.
    """
    counts = [-(-delay_interval // delay) for delay in delays]
    cycle = F.floor(number / sum(counts))
    within = F.pmod(number, F.lit(sum(counts)))
    position = None
    before = 0
    for phase, (count, delay) in enumerate(zip(counts, delays)):
        here = F.lit(phase * delay_interval) + (within - before) * delay
        position = F.when(within < before + count, here) if position is None else position.when(within < before + count, here)
        before += count
    return cycle * (delay_interval * len(delays)) + position
