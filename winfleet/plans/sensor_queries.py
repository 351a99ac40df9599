"""Sensor windows, text lines, buckets and streams over the events table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions.keys import uuid_key
from winfleet.functions.text import sensor_display, sensor_line, window_display, window_line
from winfleet.functions.times import epoch_millis, format_time, hour_bucket, parse_time, time_from_millis
from winfleet.operators.windows import average_temperature, maximum_temperature
from winfleet.plans.registry import query
from winfleet.plans.views import table
from winfleet.session import shared_dir
from winfleet.sources.sensor import event_stream, sensor_rows, table_stream
from winfleet.streaming.fanout import start_fanout_job
from winfleet.streaming.jobs import fork_job, job_batches, job_output, start_average_job, start_maximum_job
from winfleet.streaming.rolling import read_rolled
from winfleet.streaming.sinks import bucket_counts, read_buckets, sensor_lines, window_lines, write_buckets

HOUR = timedelta(minutes=60)
# The test table holds doubles that stand for two decimals.
TWO_DECIMALS = T.DecimalType(18, 2)
DEMO_SIZE, DEMO_SLIDE, DEMO_LATENESS = timedelta(seconds=60), timedelta(seconds=10), timedelta(seconds=5)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_rows(table(spark, sf_dir, "events"), kind=TWO_DECIMALS)


def _seconds(length: timedelta) -> int:
    return length // timedelta(seconds=1)


HALF_DOWN = (
    "CAST(CAST(sign(CAST(sum(v) * 100 AS HUGEINT)) * ((2 * abs(CAST(sum(v) * 100 AS HUGEINT)) + count(*) - 1) "
    "// (2 * count(*))) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"
)
MAXIMUM = "CAST(max(v) AS DECIMAL(18,2))"


NATIVE_HALF_DOWN = HALF_DOWN.replace("* 100 AS", "* 1000000 AS").replace("+ count(*) - 1", "+ 10000 * count(*) - 1").replace("(2 * count(*))", "(20000 * count(*))")


def windows_sql(aggregate: str, size: timedelta, slide: timedelta, kind: str = "DECIMAL(18,2)") -> str:
    """Window rows ``location_id, window_start, temperature``, straight from the definition of a window."""
    size_s, slide_s = _seconds(size), _seconds(slide)
    back = (-(-size_s // slide_s) - 1) * slide_s
    return (
        f"WITH base AS (SELECT user_id, ts, CAST(value AS {kind}) AS v, "
        f"time_bucket(INTERVAL {slide_s} SECOND, ts, TIMESTAMP '1970-01-01') AS b FROM events), "
        f"spread AS (SELECT user_id, ts, v, unnest(generate_series(b - INTERVAL {back} SECOND, b, INTERVAL {slide_s} SECOND)) "
        f"AS ws FROM base) "
        f"SELECT user_id AS location_id, ws AS window_start, {aggregate} AS temperature FROM spread "
        f"WHERE ts < ws + INTERVAL {size_s} SECOND GROUP BY user_id, ws"
    )


def _window_query(
    name: str, operator: Callable[..., DataFrame], sql: str, size: timedelta, slide: timedelta, panes: bool | None = None
) -> None:
    @query(name, windows_sql(sql, size, slide))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        windows = operator(readings(spark, sf_dir), size, slide, panes)
        return windows.withColumn("temperature", F.col("temperature").cast("decimal(18,2)"))


_AVG, _MAX = (average_temperature, HALF_DOWN), (maximum_temperature, MAXIMUM)
_window_query("sliding_avg_temperature", *_AVG, HOUR, timedelta(minutes=5))
_window_query("sliding_max_temperature", *_MAX, HOUR, timedelta(minutes=5))
_window_query("sliding_avg_temperature_rowwise", *_AVG, HOUR, timedelta(minutes=5), panes=False)
_window_query("sliding_max_temperature_rowwise", *_MAX, HOUR, timedelta(minutes=5), panes=False)
_window_query("sliding_avg_temperature_60s", *_AVG, DEMO_SIZE, DEMO_SLIDE)
_window_query("sliding_max_temperature_60s", *_MAX, DEMO_SIZE, DEMO_SLIDE)
_window_query("sliding_avg_temperature_uneven", *_AVG, HOUR, timedelta(minutes=7))
_window_query("tumbling_avg_temperature", *_AVG, HOUR, HOUR)
_window_query("tumbling_max_temperature", *_MAX, HOUR, HOUR)
_window_query("gapped_window_avg", *_AVG, timedelta(minutes=5), timedelta(minutes=10))
_window_query("gapped_window_max", *_MAX, timedelta(minutes=5), timedelta(minutes=10))


@query("sliding_avg_temperature_native", windows_sql(NATIVE_HALF_DOWN, HOUR, timedelta(minutes=5), "DECIMAL(24,6)"))
def _sliding_avg_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the values as they come, with all six decimals that sensor rows keep."""
    windows = average_temperature(sensor_rows(table(spark, sf_dir, "events")))
    return windows.withColumn("temperature", F.col("temperature").cast("decimal(18,2)"))


_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_ROW_TIME = _TIME.format("ts")
_ROW_VALUE = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"


@query(
    "sensor_rows",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_time, user_id AS location_id, "
    "CAST(value AS DECIMAL(18,2)) AS temperature FROM events",
)
def _sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("temperature", F.col("temperature").cast("decimal(18,2)"))


@query("sensor_csv_line", f"SELECT {_ROW_TIME} || ',' || event_id || ',' || user_id || ',' || {_ROW_VALUE} AS line FROM events")
def _sensor_csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("event_time", "event_id", "location_id", "temperature")]
    return readings(spark, sf_dir).select(sensor_line(*columns).alias("line"))


@query(
    "sensor_display_line",
    f"SELECT {_ROW_TIME} || ', ' || event_id || ', ' || user_id || ', ' || {_ROW_VALUE} AS line FROM events",
)
def _sensor_display_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("event_time", "event_id", "location_id", "temperature")]
    return readings(spark, sf_dir).select(sensor_display(*columns).alias("line"))


def _line_sql(separator: str) -> str:
    inner = windows_sql(HALF_DOWN, HOUR, timedelta(minutes=5))
    return (
        f"SELECT {_TIME.format('window_start')} || '{separator}' || location_id || '{separator}' || "
        f"CAST(temperature AS VARCHAR) AS line FROM ({inner})"
    )


@query("avg_csv_line", _line_sql(","))
def _avg_csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("window_start", "location_id", "temperature")]
    return average_temperature(readings(spark, sf_dir)).select(window_line(*columns).alias("line"))


@query("avg_display_line", _line_sql(", "))
def _avg_display_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("window_start", "location_id", "temperature")]
    return average_temperature(readings(spark, sf_dir)).select(window_display(*columns).alias("line"))


@query(
    "time_format_roundtrip",
    f"SELECT event_id, {_ROW_TIME} AS text, epoch_ms(date_trunc('milliseconds', ts)) AS millis, "
    "date_trunc('milliseconds', ts) AS back FROM events",
)
def _time_format_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", format_time(F.col("ts")).alias("text"))
    rows = rows.withColumn("millis", parse_time(F.col("text")))
    return rows.withColumn("back", time_from_millis(F.col("millis")).cast("timestamp_ntz"))


@query(
    "key_uuid",
    "SELECT c_custkey, '00000000-0000-0000-' || substr(lpad(lower(to_hex(c_custkey)), 16, '0'), 1, 4) || '-' || "
    "substr(lpad(lower(to_hex(c_custkey)), 16, '0'), 5) AS key FROM customer",
)
def _key_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", uuid_key(F.col("c_custkey")).alias("key"))


_BUCKET = "strftime({}, '%Y-%m-%d--%H')"


@query("bucket_counts", f"SELECT {_BUCKET.format('ts')} AS bucket, count(*) AS n FROM events GROUP BY 1")
def _bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    return bucket_counts(rows.select(hour_bucket(F.col("event_time")).alias("bucket")))


@query(
    "avg_bucket_counts",
    f"SELECT {_BUCKET.format('window_start')} AS bucket, count(*) AS n FROM "
    f"({windows_sql(HALF_DOWN, HOUR, timedelta(minutes=5))}) GROUP BY 1",
)
def _avg_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_counts(window_lines(average_temperature(readings(spark, sf_dir))))


@query(
    "sensor_bucket_files",
    f"SELECT {_BUCKET.format('ts')} AS bucket, {_ROW_TIME} || ',' || event_id || ',' || user_id || ',' || {_ROW_VALUE} "
    "AS value FROM events",
)
def _sensor_bucket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    path = shared_dir(spark, "sensor-buckets")
    write_buckets(sensor_lines(rows), path)
    return read_buckets(spark, path).select("bucket", "value")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return sensor_rows(table_stream(spark, sf_dir, "events", schema), kind=TWO_DECIMALS)


def _closed_sql(aggregate: str) -> str:
    """Window rows as text, of the windows that the watermark has closed by the end of the stream."""
    inner = windows_sql(aggregate, HOUR, timedelta(minutes=5))
    return (
        f"SELECT {_BUCKET.format('window_start')} AS bucket, {_TIME.format('window_start')} || ',' || location_id || ',' || "
        f"CAST(temperature AS VARCHAR) AS value FROM ({inner}) WHERE window_start + INTERVAL 60 MINUTE <= "
        f"(SELECT max(ts) FROM events) - INTERVAL 5 SECOND"
    )


def _run_job(spark: SparkSession, sf_dir: str, start: Callable[..., list], part: str) -> DataFrame:
    output, checkpoints = shared_dir(spark, "out"), shared_dir(spark, "progress")
    settings = {"lateness": DEMO_LATENESS, "interval": None}
    for running in start(_stream(spark, sf_dir), output, checkpoints, **settings):
        running.awaitTermination()
    return read_rolled(spark, job_output(output, "run", part))


@query("stream_avg_temperature", _closed_sql(HALF_DOWN))
def _stream_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_job(spark, sf_dir, start_average_job, "average")


# Early rows arrive first; a tenth of the earlier half of time comes late, after a restart, together with the later half.
_LATE_SQL = f"""
WITH base AS (
    SELECT user_id, ts, CAST(value AS DECIMAL(18,2)) AS v, time_bucket(INTERVAL 300 SECOND, ts, TIMESTAMP '1970-01-01') AS b,
        epoch_us(ts) < (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events) AND event_id % 10 <> 0 AS early
    FROM events
), spread AS (SELECT *, unnest(generate_series(b - INTERVAL 3300 SECOND, b, INTERVAL 300 SECOND)) AS ws FROM base),
windows AS (
    SELECT user_id, ws, {HALF_DOWN} AS temperature FROM spread
    WHERE ts < ws + INTERVAL 60 MINUTE
      AND (early OR ws + INTERVAL 60 MINUTE > (SELECT max(ts) FROM base WHERE early) - INTERVAL 5 SECOND)
      AND ws + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND
    GROUP BY user_id, ws
)
SELECT {_BUCKET.format('ws')} AS bucket, {_TIME.format('ws')} || ',' || user_id || ',' || CAST(temperature AS VARCHAR) AS value FROM windows
"""


@query("stream_late_rows_after_restart", _LATE_SQL)
def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that ends, and goes on from its checkpoints when more files have come: late rows count in open windows only."""
    events = table(spark, sf_dir, "events")
    folder, output, checkpoints = shared_dir(spark, "arrivals"), shared_dir(spark, "out"), shared_dir(spark, "progress")
    settings = {"lateness": DEMO_LATENESS, "interval": None}
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = events.select(F.expr("(unix_micros(min(cast(ts AS timestamp))) + unix_micros(max(cast(ts AS timestamp)))) div 2")).scalar()
    early = F.coalesce((micros < middle) & (F.col("event_id") % 10 != 0), F.lit(False))
    for arrived in (early, ~early):
        events.where(arrived).write.mode("append").parquet(folder)
        rows = sensor_rows(event_stream(spark, folder, events.schema), kind=TWO_DECIMALS)
        for running in start_average_job(rows, output, checkpoints, **settings):
            running.awaitTermination()
    return read_rolled(spark, job_output(output, "run", "average"))


@query("stream_max_temperature", _closed_sql(MAXIMUM))
def _stream_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_job(spark, sf_dir, start_maximum_job, "maximum")


# Time in thirds. A run takes all of them, in turn; a fork of it after the second third goes on with readings doubled.
_FORK_SQL = f"""
WITH bounds AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events), base AS (
    SELECT user_id, ts, CAST(CASE WHEN epoch_us(ts) < (SELECT low + 2 * ((high - low) // 3) FROM bounds) THEN value ELSE 2 * value END AS DECIMAL(18,2)) AS v,
        time_bucket(INTERVAL 300 SECOND, ts, TIMESTAMP '1970-01-01') AS b
    FROM events
), spread AS (SELECT *, unnest(generate_series(b - INTERVAL 3300 SECOND, b, INTERVAL 300 SECOND)) AS ws FROM base),
windows AS (
    SELECT user_id, ws, {HALF_DOWN} AS temperature FROM spread
    WHERE ts < ws + INTERVAL 60 MINUTE AND ws + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND
    GROUP BY user_id, ws
)
SELECT {_BUCKET.format('ws')} AS bucket, {_TIME.format('ws')} || ',' || user_id || ',' || CAST(temperature AS VARCHAR) AS value FROM windows
"""


@query("stream_fork_of_saved_state", _FORK_SQL)
def _stream_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over three thirds of time, and a fork of its state after the second one that takes another last third."""
    events = table(spark, sf_dir, "events")
    arrivals, others = shared_dir(spark, "arrivals"), shared_dir(spark, "other-arrivals")
    output, checkpoints = shared_dir(spark, "out"), shared_dir(spark, "progress")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    third = F.floor((micros - F.lit(low)) / F.lit(max(1, (high - low) // 3)))

    def run(folder: str, name: str) -> None:
        rows = sensor_rows(event_stream(spark, f"{folder}/*.parquet", events.schema), kind=TWO_DECIMALS)
        for running in start_average_job(rows, output, checkpoints, name, lateness=DEMO_LATENESS, interval=None):
            running.awaitTermination()

    saved = {}
    for part in (third == 0, third == 1, third > 1):
        saved = {query: batches[-1] for query, batches in job_batches(checkpoints, "first", "average").items() if batches}
        events.where(part).write.mode("append").parquet(arrivals)
        run(arrivals, "first")
    fork_job(spark, output, checkpoints, "first", "fork", "average", saved)
    events.where(third > 1).withColumn("value", F.col("value") * 2).write.parquet(others)
    run(others, "fork")
    return read_rolled(spark, job_output(output, "fork", "average"))


def _fan_out(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """Rows and windows of one query that reads each of three arrivals once, restarted between them."""
    events = table(spark, sf_dir, "events")
    folder, output, checkpoints = shared_dir(spark, "arrivals"), shared_dir(spark, "out"), shared_dir(spark, "progress")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    third = F.coalesce(F.least(F.floor((micros - F.lit(low)) / F.lit(max(1, ((high or 0) - (low or 0)) // 3))), F.lit(2)), F.lit(2))
    for k in range(3):
        events.where(third == k).write.mode("append").parquet(folder)
        rows = sensor_rows(event_stream(spark, folder, events.schema), kind=TWO_DECIMALS)
        start_fanout_job(rows, output, checkpoints, part=part, lateness=DEMO_LATENESS, interval=None).awaitTermination()
    sinks = [read_rolled(spark, job_output(output, "run", sink)).withColumn("sink", F.lit(sink)) for sink in ("sensor", part)]
    return sinks[0].unionByName(sinks[1])


def _fan_out_sql(aggregate: str, part: str) -> str:
    rows = f"SELECT {_BUCKET.format('ts')} AS bucket, {_ROW_TIME} || ',' || event_id || ',' || user_id || ',' || {_ROW_VALUE} AS value, 'sensor' AS sink FROM events"
    return f"{rows} UNION ALL SELECT bucket, value, '{part}' AS sink FROM ({_closed_sql(aggregate)})"


@query("stream_fan_out_average", _fan_out_sql(HALF_DOWN, "average"))
def _stream_fan_out_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan_out(spark, sf_dir, "average")


@query("stream_fan_out_maximum", _fan_out_sql(MAXIMUM, "maximum"))
def _stream_fan_out_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan_out(spark, sf_dir, "maximum")
