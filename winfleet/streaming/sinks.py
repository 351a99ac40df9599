"""Lines in hour buckets, text files of tables of them, the console, and triggers. Folders are named ``bucket=yyyy-MM-dd--HH``.

Files of streams are in ``rolling``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from winfleet.functions.text import sensor_line, window_line
from winfleet.functions.times import hour_bucket

BUCKETED = T.StructType([T.StructField("value", T.StringType()), T.StructField("bucket", T.StringType())])

def sensor_lines(rows: DataFrame) -> DataFrame:
    """``value, bucket`` of sensor rows; the bucket is the hour of the event."""
    columns: list[Column] = [F.col(c) for c in ("event_time", "event_id", "location_id", "temperature")]
    return rows.select(sensor_line(*columns).alias("value"), hour_bucket(F.col("event_time")).alias("bucket"))


def window_lines(windows: DataFrame) -> DataFrame:
    """``value, bucket`` of window rows; the bucket is the hour in which the window starts."""
    columns: list[Column] = [F.col(c) for c in ("window_start", "location_id", "temperature")]
    return windows.select(window_line(*columns).alias("value"), hour_bucket(F.col("window_start")).alias("bucket"))


def write_buckets(lines: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write a table of lines. The rebalance hint brings a bucket's rows together, so that not every task writes to every
    folder, and lets AQE split a bucket that is too large for one task. Files are as large as AQE's partitions
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) unless ``rows_per_file`` is above 0."""
    balanced = lines.hint("rebalance", "bucket")
    balanced.write.partitionBy("bucket").option("maxRecordsPerFile", rows_per_file).text(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their bucket. A filter on ``bucket`` prunes folders."""
    return spark.read.schema(BUCKETED).text(path)


def bucket_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("bucket").agg(F.count("*").alias("n"))


def stream_console(rows: DataFrame, checkpoint: str, trigger: dict[str, object], update: bool = False) -> StreamingQuery:
    writer = rows.writeStream.format("console").outputMode("update" if update else "append").option("truncate", "false")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def every(interval: timedelta | None) -> dict[str, object]:
    """A trigger: a micro-batch per interval, or, for None, all that is there and then stop."""
    if interval is None:
        return {"availableNow": True}
    return {"processingTime": f"{interval // timedelta(milliseconds=1)} milliseconds"}
