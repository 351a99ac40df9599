"""Streamed forms of the change-log operators."""

from __future__ import annotations

import json
import re
import uuid
from datetime import timedelta

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from winfleet.operators.state import REMEMBERED, compacted, latest_state, status_changes
from winfleet.streaming.sinks import every


# A run is merged into the next one as long as it has at most this many times the rows of what has been merged so far.
MERGE_FACTOR = 2


def _list_name(path: str, batch: int) -> str:
    return f"{path}/_runs/{batch}.json"


def _recorded(filesystem: fs.FileSystem, base: str) -> list[int]:
    found = filesystem.get_file_info(fs.FileSelector(f"{base}/_runs", allow_not_found=True))
    return [int(f.base_name.removesuffix(".json")) for f in found if re.fullmatch(r"-?\d+\.json", f.base_name)]


def runs_after(path: str, batch: int | None = None) -> tuple[int | None, list[tuple[int, int]]]:
    """A micro-batch, by default the last that ended, and the runs that make up the state after it, oldest first: (run, rows)."""
    filesystem, base = fs.FileSystem.from_uri(path)
    batches = _recorded(filesystem, base)
    batch = max(batches, default=None) if batch is None else batch
    if batch is None or batch not in batches:
        return None, []
    with filesystem.open_input_stream(_list_name(base, batch)) as file:
        return batch, [tuple(run) for run in json.loads(file.read())]


def _record_runs(path: str, batch: int, runs: list[tuple[int, int]]) -> None:
    """Record the runs after a micro-batch. Lists of this and later numbers, which an earlier attempt has left, no longer hold."""
    filesystem, base = fs.FileSystem.from_uri(path)
    filesystem.create_dir(f"{base}/_runs", recursive=True)
    for other in _recorded(filesystem, base):
        if other >= batch:
            filesystem.delete_file(_list_name(base, other))
    partial = f"{base}/_runs/.{batch}-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(partial) as out:
        out.write(json.dumps(runs).encode())
    filesystem.move(partial, _list_name(base, batch))


def _read_runs(spark: SparkSession, path: str, schema: T.StructType, runs: list[tuple[int, int]]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/batch={run}" for run, _ in runs])


def start_latest_state(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    key: list[str],
    seq: str = "seq",
    op: str = "op",
    scope: list[str] | None = None,
    interval: timedelta | None = None,
    in_order: bool = False,
) -> StreamingQuery:
    """Keep a change stream as a compact table below ``path``, read with ``read_latest_state``.

    The table is a list of runs, each a compacted log: one row per key, and the last reset. A micro-batch writes one run: its own
    rows, merged with those newest runs that have not many more rows than it (``MERGE_FACTOR``). So each run has more rows
    than all newer ones together, give or take the factor; the table stays within a constant factor of its largest run, that is of
    the keys, and a row is rewritten about as often as the table doubles. A batch writes into folders of its number and ends with the
    list of its runs, so a batch that is replayed after a failure changes nothing and readers see whole lists only. Order within and
    between batches is ``seq``, also for a reset amid a batch. With ``in_order``, no later batch has a smaller ``seq``; a run
    that takes in all others then drops deletes and resets, so the table follows the live keys and not all keys ever seen.
    """
    schema = changes.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, runs = runs_after(path, batch_id - 1)
        fresh = compacted(batch, key, seq, op, scope).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total, taken = fresh.count(), 0
            while taken < len(runs) and runs[-1 - taken][1] <= MERGE_FACTOR * total:
                total, taken = total + runs[-1 - taken][1], taken + 1
            kept, merged = runs[: len(runs) - taken], runs[len(runs) - taken :]
            rows = fresh
            if merged:
                rows = fresh.unionByName(_read_runs(spark, path, schema, merged))
                rows = compacted(rows, key, seq, op, scope) if kept or not in_order else latest_state(rows, key, seq, op, scope)
            folder = f"{path}/batch={batch_id}"
            rows.write.mode("overwrite").parquet(folder)
            written = spark.read.schema(schema).parquet(folder).count()
            _record_runs(path, batch_id, [*kept, (batch_id, written)])
        finally:
            fresh.unpersist()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**every(interval)).start()


def read_latest_state(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: list[str],
    seq: str = "seq",
    op: str = "op",
    scope: list[str] | None = None,
    batch: int | None = None,
) -> DataFrame:
    """The live rows of the table that ``start_latest_state`` keeps, after a micro-batch, by default the last that ended.

    The list of runs is taken when this is called; later batches add folders and touch none of these.
    """
    return latest_state(_read_runs(spark, path, schema, runs_after(path, batch)[1]), key, seq, op, scope)


def drop_old_runs(path: str, keep: int = 10) -> list[int]:
    """Remove the folders of runs that the lists of the last ``keep`` micro-batches do not name, and older lists. Returns the runs.

    Readers that started before those micro-batches must have ended.
    """
    filesystem, base = fs.FileSystem.from_uri(path)
    last, _ = runs_after(path)
    if last is None:
        return []
    used = {run for batch in range(last - keep + 1, last + 1) for run, _ in runs_after(path, batch)[1]}
    gone = []
    for info in filesystem.get_file_info(fs.FileSelector(base)):
        run = info.base_name.removeprefix("batch=")
        if run != info.base_name and int(run) <= last and int(run) not in used:
            filesystem.delete_dir(info.path)
            gone.append(int(run))
    for batch in _recorded(filesystem, base):
        if batch <= last - keep:
            filesystem.delete_file(_list_name(base, batch))
    return sorted(gone)


def compact_latest_state(
    spark: SparkSession,
    path: str,
    target: str,
    schema: T.StructType,
    key: list[str],
    seq: str = "seq",
    op: str = "op",
    scope: list[str] | None = None,
) -> None:
    """Write the table below ``path`` to ``target`` as one run. Do so between two runs of the stream, which then goes on at ``target``
    with the checkpoint it has."""
    last, runs = runs_after(path)
    compacted(_read_runs(spark, path, schema, runs), key, seq, op, scope).write.parquet(f"{target}/batch=-1")
    rows = spark.read.schema(schema).parquet(f"{target}/batch=-1").count()
    _record_runs(target, -1 if last is None else last, [(-1, rows)])


def start_status_changes(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    time: str = "ts",
    seq: str = "seq",
    watched: tuple[str, ...] = ("status",),
    remembered: timedelta = REMEMBERED,
    lateness: timedelta = timedelta(hours=1),
    block: str | None = "minute",
    interval: timedelta | None = None,
) -> StreamingQuery:
    """Write the status changes of a stream below ``path``, read with ``read_status_changes``.

    A micro-batch is a table, so the batch operator does the work, with its protection against keys that hold most of the
    rows. What it needs from the past is each key's last row: micro-batches leave these in two folders in turn, and take
    those of the number before as rows that were seen already. A batch replaces its own folders and reads the other one, so
    replayed after a failure it changes nothing. Memory expires in event time, as in a table; when input arrives in order the stream's changes
    are the table's. A row older than its key's last one is compared with older rows of its own micro-batch only.
    A key is forgotten once its last row is older than the newest row of all by more than ``remembered`` and ``lateness``: while
    no row comes later than that, its next row is a change in any case. So the state holds the keys of that span, not all keys
    ever seen. Each micro-batch is computed once and kept while it is written; ``block`` is short, because a micro-batch spans
    little time.
    """
    spark = rows.sparkSession
    known = list(dict.fromkeys([time, seq, *watched]))
    last_type = rows.select(key, *known).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.withColumn("_old", F.lit(False))
        if batch_id > 0:
            old = spark.read.schema(last_type).parquet(f"{path}/last/slot={(batch_id - 1) % 2}")
            seen = seen.unionByName(old.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            changes = status_changes(seen, key, time, seq, watched, remembered, block).where("NOT _old").drop("_old")
            changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
            newest = seen.groupBy(key).agg(F.max(F.struct(*known)).alias("_last")).select(key, "_last.*")
            oldest = seen.select(F.max(time) - F.lit(remembered + lateness)).scalar()
            newest = newest.where(F.col(time).isNull() | (F.col(time) >= oldest))
            newest.write.mode("overwrite").parquet(f"{path}/last/slot={batch_id % 2}")
        finally:
            seen.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**every(interval)).start()


def read_status_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(stored).parquet(f"{path}/changes").drop("batch")
