"""A sensor job as one query: rows and windows from a single scan of the source, always at the same micro-batch.

``streaming.jobs`` runs a query per sink, and each of them reads and decodes the source. Here a micro-batch is read once and kept
while both sinks take it: its rows as lines, and its rows reduced to panes, which join the open panes of the micro-batch before.
Windows are made of panes when the watermark closes them, so the state has one row per key and pane, not one per key and window.

Everything is written under the micro-batch's number, and nothing but the numbers before it is read: a micro-batch that failed
anywhere and runs again replaces what it had written. Folders below the checkpoint:

* ``panes/batch=<n>/`` panes that had an open window before micro-batch n ended, with its own rows
* ``clock/batch=<n>/`` the watermark after micro-batch n
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winfleet.functions.times import micros
from winfleet.operators.windows import with_spans
from winfleet.streaming.jobs import JobSettings, job_output
from winfleet.streaming.panes import Measure, average_measure, maximum_measure, windows_between
from winfleet.streaming.rolling import write_rolled
from winfleet.streaming.sinks import every, sensor_lines, window_lines

# States of this many micro-batches are kept: the last one's, and the one before, from which the last could run again.
KEPT = 2


def _drop_before(folder: str, batch: int) -> None:
    filesystem, base = fs.FileSystem.from_uri(folder)
    for found in filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        number = re.fullmatch(r"batch=(\d+)", found.base_name)
        if number and int(number[1]) < batch:
            filesystem.delete_dir(found.path)


def closed_windows(batch: DataFrame, number: int, state: str, measure: Measure, size: timedelta, slide: timedelta, lateness: timedelta) -> DataFrame:
    """Take a micro-batch of sensor rows into the state, and return the windows that it closes.

    The watermark is the largest event time so far less ``lateness``. A row counts in those of its windows that were open before
    its micro-batch; a window that ends at or before the new watermark is closed. Rows without time or temperature are in no window
    and do not move the watermark. An empty micro-batch closes nothing.
    """
    spark = batch.sparkSession
    before = None
    if number:
        before = spark.read.schema("clock long").parquet(f"{state}/clock/batch={number - 1}").first()[0]
    newest = batch.where("temperature IS NOT NULL").agg(F.max(F.unix_micros(F.col("event_time").cast("timestamp")))).first()[0]
    clocks = [c for c in (before, None if newest is None else newest - micros(lateness)) if c is not None]
    clock = max(clocks, default=None)

    fresh = with_spans(measure.readings(batch), size, slide).groupBy("location_id", "first", "last").agg(*measure.partial)
    ends = F.unix_micros(F.col("last").cast("timestamp")) + micros(size)
    if before is not None:
        held = spark.read.schema(fresh.schema).parquet(f"{state}/panes/batch={number - 1}")
        fresh = fresh.unionByName(held).where(ends > before).groupBy("location_id", "first", "last").agg(*measure.merge)
    path = f"{state}/panes/batch={number}"
    fresh.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(clock,)], "clock long").coalesce(1).write.mode("overwrite").parquet(f"{state}/clock/batch={number}")
    panes = spark.read.schema(fresh.schema).parquet(path)
    return windows_between(panes, before, clock, measure, size, slide)


def start_fanout_job(
    rows: DataFrame, output: str, checkpoints: str, run: str = "run", part: str = "average", **settings: object
) -> StreamingQuery:
    """One query that writes ``job_output(output, run, "sensor")`` and ``job_output(output, run, part)``.

    ``part`` is ``average`` or ``maximum``, ``settings`` are those of JobSettings. Results are those of the jobs with a query per
    sink over the same input: late rows, closed windows and the files' layout follow the same rules. Windows must overlap or touch.
    """
    own = JobSettings(**settings)
    if own.slide > own.size:
        raise ValueError("windows must not leave gaps")
    measure = {"average": average_measure, "maximum": maximum_measure}[part](rows)
    state = f"{checkpoints}/{run}/{part}/state"

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_rolled(sensor_lines(batch), job_output(output, run, "sensor"), number, own.rolling)
            windows = closed_windows(batch, number, state, measure, own.size, own.slide, own.lateness)
            write_rolled(window_lines(windows), job_output(output, run, part), number, own.rolling)
            for folder in ("panes", "clock"):
                _drop_before(f"{state}/{folder}", number - KEPT + 1)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoints}/{run}/{part}/both")
    return writer.trigger(**every(own.interval)).start()
