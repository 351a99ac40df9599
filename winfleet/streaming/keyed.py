"""Status changes and silences of a stream with state per key and timers in event time.

Each key holds the rows that the watermark has not passed and the last row it was judged by. A timer at the earliest held row fires
once the watermark has passed it; the rows up to there are then taken in order of (time, seq), so rows may arrive in any
order within ``lateness``. A later timer fires when a key has been silent for its limit: status changes then forget the key, as its
next row is a change in any case, and alerts are raised. A micro-batch touches only the keys that it has rows of and those whose timers fire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from itertools import chain, islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from winfleet.operators.state import REMEMBERED
from winfleet.session import importable
from winfleet.streaming.sinks import every

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLI, _MICRO = timedelta(milliseconds=1), timedelta(microseconds=1)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_CHUNK = 4096  # rows of a key in one piece of its state


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with their state in RocksDB, which keyed state and timers need. A query reads the setting when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Takes each key's rows in order of (time, seq) once the watermark has passed them, and wakes when a key has been silent.

    Rows hold the columns of ``schema``, the key's and ``_at`` (microseconds since the epoch) among them. Of a key it keeps the
    rows to come and the last row taken. Every call of the state goes to the JVM and back, where each value is encoded with its
    schema, and Python builds input rows cell by cell. So rows to come are held by columns, thousands in one value, no state
    says which timers are set (what is done at one depends on rows and watermark alone, so one too many does nothing), and the
    input has few cells: columns beside the key's and ``_at``, and ``_mark``.
    """

    def __init__(self, schema: T.StructType, key: str, seq: str, limit: timedelta):
        self.schema = schema
        self.names = schema.names
        self.key, self.at, self.seq = self.names.index(key), self.names.index("_at"), self.names.index(seq)
        self.limit = limit // _MICRO

    def taken(self, last: tuple | None, row: tuple) -> Iterator[tuple]:
        """What a row gives after the last one; that is None at first and after a silence."""
        raise NotImplementedError

    def silent(self, last: tuple) -> Iterator[tuple]:
        """What it gives that no row has come within the limit after the last one."""
        return iter(())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*self.names)
        self.held = handle.getListState("held", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.schema]))
        self.last = handle.getValueState("last", self.schema)
        self.judged: set[str] = set()

    def _wake(self, micros: int) -> None:
        """Fire once the watermark has reached this time."""
        self.handle.registerTimer(-(-micros // 1000))

    @staticmethod
    def _chunks(rows: Iterable[tuple]) -> Iterator[tuple]:
        rows = iter(rows)
        while part := list(islice(rows, _CHUNK)):
            yield tuple(map(list, zip(*part)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(rows)
        cells = itemgetter(*(first.__fields__.index("_mark" if c == "_at" else c) for c in self.names))
        earliest = []
        for columns in self._chunks(map(cells, chain((first,), rows))):
            times = [(mark - _EPOCH) // _MICRO for mark in columns[self.at]]
            self.held.appendValue((*columns[: self.at], times, *columns[self.at + 1 :]))
            earliest.append(min(times))
        self._wake(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        name = str(key)
        if name in self.judged:
            return  # by another timer, at this watermark
        if len(self.judged) == _CHUNK:
            self.judged.clear()
        self.judged.add(name)
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [row for columns in self.held.get() for row in zip(*columns)]
        ready = sorted((row for row in held if row[self.at] <= now), key=itemgetter(self.at, self.seq))
        before = last = self.last.get()
        for row in ready:
            if last is not None and row[self.at] > last[self.at] + self.limit:
                yield from (self.row(*values) for values in self.silent(last))
                last = None
            yield from (self.row(*values) for values in self.taken(last, row))
            last = row
        if last is not None and last[self.at] + self.limit <= now:
            yield from (self.row(*values) for values in self.silent(last))
            last = None
        if last is before and not ready:
            return  # a timer that an earlier one has replaced
        waiting = [row for row in held if row[self.at] > now] if len(ready) < len(held) else []
        if ready and waiting:
            self.held.put(list(self._chunks(waiting)))
        elif ready:
            self.held.clear()
        times = [row[self.at] for row in waiting]
        if last is not None:
            self.last.update(last)
            times.append(last[self.at] + self.limit)
        elif before is not None:
            self.last.clear()
        if times:
            self._wake(min(times))

    def close(self) -> None:
        pass


class StatusChanges(InOrder):
    """A key's first row, one that differs in a watched column, and one after a silence."""

    def __init__(self, schema: T.StructType, key: str, seq: str, limit: timedelta, watched: tuple[str, ...]):
        super().__init__(schema, key, seq, limit)
        self.watched = [self.names.index(c) for c in watched]

    def taken(self, last: tuple | None, row: tuple) -> Iterator[tuple]:
        if last is None or any(row[i] != last[i] for i in self.watched):
            yield row


class Silences(InOrder):
    """The last row before each silence, once."""

    def taken(self, last: tuple | None, row: tuple) -> Iterator[tuple]:
        return iter(())

    def silent(self, last: tuple) -> Iterator[tuple]:
        yield last


def _in_order(rows: DataFrame, key: str, time: str, lateness: timedelta, needed: tuple[str, ...], processor: Callable[[T.StructType], InOrder]) -> DataFrame:
    spark = rows.sparkSession
    importable(spark)
    zoned = rows.where(F.col(time).isNotNull()).withColumn("_mark", F.col(time).cast("timestamp"))
    marked = zoned.withWatermark("_mark", f"{lateness // _MILLI} milliseconds")
    kind = rows.schema[time].dataType
    utc = spark.conf.get("spark.sql.session.timeZone") == "UTC"
    told = time != key and time not in needed and (kind == T.TimestampType() or kind == T.TimestampNTZType() and utc)  # by _at alone
    if told:
        marked = marked.drop(time)
    kept = T.StructType([*(f for f in rows.schema if not (told and f.name == time)), T.StructField("_at", T.LongType())])
    out = marked.groupBy(key).transformWithState(processor(kept), kept, "append", "EventTime")
    if told:
        out = out.withColumn(time, F.timestamp_micros("_at").cast(kind))
    return out.select(*rows.columns)


def keyed_status_changes(
    rows: DataFrame,
    key: str,
    time: str = "ts",
    seq: str = "seq",
    watched: tuple[str, ...] = ("status",),
    remembered: timedelta = REMEMBERED,
    lateness: timedelta = timedelta(hours=1),
) -> DataFrame:
    """The rows of a stream that ``status_changes`` gives of the same rows as a table, as far as the watermark has come.

    The watermark stays ``lateness`` behind the newest row; a row is judged when it has passed. Rows that arrive after that are
    dropped, as are rows without a time. A key's rows are held by one task, ``lateness`` worth of them at a time. ``seq`` is
    not null and unique within a key and time.
    """
    return _in_order(rows, key, time, lateness, (seq, *watched), lambda kept: StatusChanges(kept, key, seq, remembered, watched))


def keyed_silences(
    rows: DataFrame, key: str, limit: timedelta, time: str = "ts", seq: str = "seq", lateness: timedelta = timedelta(hours=1)
) -> DataFrame:
    """The last row of a key before each silence of a stream: no row of the key within ``limit`` after it.

    A silence is told once, when the watermark has passed its limit, whether or not another row comes; a timer does so, for which
    no event is needed. Rows may come in any order within ``lateness``. Overdue jobs and due periodic actions are such silences:
    they begin at the row's time plus ``limit``.
    """
    return _in_order(rows, key, time, lateness, (seq,), lambda kept: Silences(kept, key, seq, limit))


def start_keyed(changes: DataFrame, path: str, checkpoint: str, interval: timedelta | None = None) -> StreamingQuery:
    """Write what ``keyed_status_changes`` or ``keyed_silences`` gives as Parquet files below ``path``, each row once."""
    with rocksdb_state(changes.sparkSession):
        writer = changes.writeStream.format("parquet").outputMode("append").option("path", path)
        return writer.option("checkpointLocation", checkpoint).trigger(**every(interval)).start()
