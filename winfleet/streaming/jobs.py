"""The two sensor jobs: watermark, sliding window, and two bucketed text sinks.

A job runs one query per sink over the same source, each with its own checkpoint, so one can be stopped, lost or
restarted without the other. Restarting with the same ``run`` continues from its checkpoints; a new ``run`` ignores them
and starts anew beside them, in folders of its own. ``fork_job`` makes a new run out of a saved state of another one.
"""

from __future__ import annotations

from contextlib import contextmanager
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from winfleet.operators.windows import DEFAULT_SIZE, DEFAULT_SLIDE, average_temperature, maximum_temperature
from winfleet.sources.sensor import with_watermark
from winfleet.streaming.keyed import rocksdb_state
from winfleet.streaming.panes import Measure, average_measure, closed_by, maximum_measure, open_panes
from winfleet.streaming.rolling import Rolling, fork_rolled, start_rolled, write_rolled
from winfleet.streaming.savepoints import fork_checkpoint, saved_batches
from winfleet.streaming.sinks import every, sensor_lines, stream_console, window_lines

_LATE_FILTER = "spark.sql.streaming.statefulOperator.allowMultiple"
# Of a row in up to this many windows the windows are state, of a row in more of them its pane is.
FEW_WINDOWS = 8


@dataclass(frozen=True)
class JobSettings:
    """Settings of a job with their usual values. ``interval`` is both the time between micro-batches, hence between
    watermark steps, and the checkpoint interval; None processes what is there and ends. ``rolling`` says when files close.
    ``panes`` says whether open panes or open windows are state (None: panes if a row is in more than FEW_WINDOWS windows); results
    are the same, but a checkpoint goes on with what it began with."""

    size: timedelta = DEFAULT_SIZE
    slide: timedelta = DEFAULT_SLIDE
    lateness: timedelta = timedelta(minutes=1)
    interval: timedelta | None = timedelta(seconds=30)
    console_verbosity: int = 0
    rolling: Rolling = Rolling()
    panes: bool | None = None


@contextmanager
def immediate_late_filter(spark: SparkSession) -> Iterator[None]:
    """Start queries that drop late rows by the current watermark.

    A row is late for a window, not as such: it still counts in its open windows. By default Spark filters with the
    watermark of the previous micro-batch, which keeps late rows one batch longer. That is needed only when stateful
    operators are chained. A query reads the setting when it starts.
    """
    before = spark.conf.get(_LATE_FILTER)
    spark.conf.set(_LATE_FILTER, "false")
    try:
        yield
    finally:
        spark.conf.set(_LATE_FILTER, before)


def windows_of(rows: DataFrame, settings: JobSettings, aggregate: Callable[..., DataFrame]) -> DataFrame:
    return aggregate(with_watermark(rows, settings.lateness), settings.size, settings.slide)


def start_average_job(rows: DataFrame, output: str, checkpoints: str, run: str = "run", **settings: object) -> list[StreamingQuery]:
    return _start(rows, output, checkpoints, run, "average", average_temperature, average_measure, JobSettings(**settings))


def start_maximum_job(rows: DataFrame, output: str, checkpoints: str, run: str = "run", **settings: object) -> list[StreamingQuery]:
    return _start(rows, output, checkpoints, run, "maximum", maximum_temperature, maximum_measure, JobSettings(**settings))


def job_output(output: str, run: str, part: str) -> str:
    """Folder of a job's ``sensor`` rows, or of its ``average`` or ``maximum`` rows."""
    return f"{output}/{run}/{part}-temperature"


def job_batches(checkpoints: str, run: str, part: str) -> dict[str, list[int]]:
    """Micro-batches of a job's two queries (``rows``, ``windows``) from which a fork can go on; ``part`` is ``average`` or ``maximum``."""
    return {query: saved_batches(f"{checkpoints}/{run}/{part}/{query}") for query in ("rows", "windows")}


def fork_job(spark: SparkSession, output: str, checkpoints: str, run: str, new_run: str, part: str, batches: dict[str, int]) -> None:
    """Make ``new_run`` out of ``run`` as it stood after the given micro-batch of each of its queries.

    The new run starts with the output of the old one up to there, and goes on when it is started with any later input. If that
    is in another folder, name the folder's files by a pattern (``folder/*.parquet``), as Spark looks up the last batch's files
    once more when a query starts, and a plain folder has to hold them. The old run is left as it is. Raises ValueError if a batch is not among ``job_batches``.
    """
    for query, batch in batches.items():
        known = saved_batches(f"{checkpoints}/{run}/{part}/{query}")
        if batch not in known:
            raise ValueError(f"no saved state of {query} after batch {batch}; there are {known}")
    for query, batch in batches.items():
        folder = "sensor" if query == "rows" else part
        fork_rolled(spark, job_output(output, run, folder), job_output(output, new_run, folder), batch)
        fork_checkpoint(spark, f"{checkpoints}/{run}/{part}/{query}", f"{checkpoints}/{new_run}/{part}/{query}", batch)


def _start_windows(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict[str, object], settings: JobSettings, measure: Measure
) -> StreamingQuery:
    """Write the lines of closed windows below ``path``, with open panes as state."""
    spark = rows.sparkSession
    panes = open_panes(with_watermark(rows, settings.lateness), measure, settings.size, settings.slide)

    def take(batch: DataFrame, number: int) -> None:
        closed = closed_by(spark, checkpoint, number, panes, measure, settings.size, settings.slide)
        write_rolled(window_lines(closed), path, number, settings.rolling)
        batch.write.format("noop").mode("overwrite").save()  # takes the micro-batch into the state

    writer = panes.writeStream.outputMode("update").foreachBatch(take)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _start(
    rows: DataFrame,
    output: str,
    checkpoints: str,
    run: str,
    part: str,
    aggregate: Callable[..., DataFrame],
    measured: Callable[[DataFrame], Measure],
    settings: JobSettings,
) -> list[StreamingQuery]:
    trigger = every(settings.interval)
    base = f"{checkpoints}/{run}/{part}"
    panes = settings.size > FEW_WINDOWS * settings.slide if settings.panes is None else settings.panes
    if panes and settings.slide > settings.size:
        raise ValueError("panes are of windows without gaps")
    with immediate_late_filter(rows.sparkSession), rocksdb_state(rows.sparkSession):
        windows = windows_of(rows, settings, aggregate)
        path = job_output(output, run, part)
        queries = [start_rolled(sensor_lines(rows), job_output(output, run, "sensor"), f"{base}/rows", trigger, settings.rolling)]
        if panes:
            queries.append(_start_windows(rows, path, f"{base}/windows", trigger, settings, measured(rows)))
        else:
            queries.append(start_rolled(window_lines(windows), path, f"{base}/windows", trigger, settings.rolling))
        if settings.console_verbosity > 1:
            queries.append(stream_console(rows, f"{base}/console-rows", trigger))
        if settings.console_verbosity > 0:
            queries.append(stream_console(windows, f"{base}/console-windows", trigger))
    return queries
