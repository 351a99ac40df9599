"""Text files in buckets that roll by size, age and idleness, written by a stream exactly once.

A micro-batch deals a bucket's lines to as many tasks as its bytes need, and a task cuts them into files of ``size`` to twice
``size`` bytes; only a bucket that has less than ``size`` gets a smaller one. Such a file stays *open*: the next micro-batch that
has lines of its bucket writes them together with its lines and takes its place, until it is full, older than ``age``, or has had no
line for ``idle``. A file is thus rewritten at most as often as micro-batches fit into ``age``.

Tasks write files under names of their own and report them; a batch's reports become its folder in the log, which also says which
open files it took up. Files count once they are in the log of a finished batch, so attempts that failed and batches that run
again leave nothing behind but files that nobody reads. Folders below the path:

* ``files/bucket=<bucket>/`` the lines
* ``log/batch=<n>/`` files added and taken up by micro-batch n
* ``open/batch=<n>/`` files that are open after it
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "bucket string, path string, bytes long, lines long, opened long, touched long"
LOG = f"{ENTRY}, added boolean"
LINES = "bucket string, value string"
# A task cuts up to this many files' worth of a bucket; a larger bucket is dealt to several tasks.
FILES_PER_TASK = 64


@dataclass(frozen=True)
class Rolling:
    """When a file is closed: at ``size`` bytes, ``age`` after it was opened, or ``idle`` after its last line."""

    size: int = 1 << 20
    age: timedelta = timedelta(minutes=5)
    idle: timedelta = timedelta(minutes=5)


def _millis(length: timedelta) -> int:
    return length // timedelta(milliseconds=1)


def _writer(files: str, size: int, now: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write rows (bucket, part, opened, value), sorted by bucket and part, and report the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.parse
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        names = ["bucket", "path", "bytes", "lines", "opened", "touched"]
        group: tuple | None = None
        opened = now
        full: list[tuple[bytes, int]] = []  # bytes and lines of a file that has its size, kept until the next one has it too
        tail: list[tuple[bytes, int]] = []
        tail_bytes = 0
        reports: list[tuple] = []

        def close(pieces: list[tuple[bytes, int]]) -> None:
            if not pieces:
                return
            bucket = group[0]
            folder = "bucket=" + ("__HIVE_DEFAULT_PARTITION__" if bucket is None else urllib.parse.quote(bucket, safe=""))
            where = f"{files}/{folder}/part-{uuid.uuid4().hex}.txt"
            filesystem, path = fs.FileSystem.from_uri(where)
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            data = b"".join(piece for piece, _ in pieces)
            with filesystem.open_output_stream(path) as out:
                out.write(data)
            reports.append((bucket, where, len(data), sum(n for _, n in pieces), opened, now))

        def end_group() -> None:
            nonlocal full, tail, tail_bytes, opened
            close(full + tail)
            full, tail, tail_bytes, opened = [], [], 0, now

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, parts = batch["bucket"], batch["part"].to_numpy(zero_copy_only=False)
            since = batch["opened"].to_numpy(zero_copy_only=False)
            codes = buckets.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            lines = pc.binary_join_element_wise(batch["value"].cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]  # where lines begin and the last one ends
            text = memoryview(lines.buffers()[2])
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)]):
                if (key := (buckets[start].as_py(), int(parts[start]))) != group:
                    end_group()
                    group = key
                while start < stop:
                    filled = int(np.searchsorted(ends, ends[start] + size - tail_bytes))  # lines before this one give a file its size
                    until = min(filled, stop)
                    opened = min(opened, int(since[start:until].min()))
                    tail.append((bytes(text[ends[start] : ends[until]]), until - start))
                    tail_bytes += int(ends[until] - ends[start])
                    if tail_bytes >= size:
                        close(full)
                        full, tail, tail_bytes = tail, [], 0
                    start = until
        end_group()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*reports)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _reader(chunk: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of files (bucket, path, opened) as rows (bucket, value, opened), those of ``chunk`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        def rows(bucket: str | None, data: bytes, opened: int) -> pa.RecordBatch:
            """Of lines that all end."""
            text = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(text == 10)
            n = len(ends)
            offsets = np.concatenate([[0], ends - np.arange(n)]).astype(np.int64)
            values = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text[text != 10].tobytes())).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(bucket, pa.string()), n), values, pa.repeat(pa.scalar(opened, pa.int64()), n)], names=["bucket", "value", "opened"])

        for batch in batches:
            for bucket, where, opened in zip(*(batch[name].to_pylist() for name in ("bucket", "path", "opened"))):
                filesystem, path = fs.FileSystem.from_uri(where)
                with filesystem.open_input_stream(path) as raw:
                    begun: list[bytes] = []  # a line that has not ended
                    while data := raw.read(chunk):
                        cut = data.rfind(b"\n") + 1
                        if cut:
                            yield rows(bucket, b"".join([*begun, data[:cut]]), opened)
                            begun = []
                        begun.append(data[cut:])
                    if rest := b"".join(begun):
                        yield rows(bucket, rest + b"\n", opened)

    return run


def _lines_of(files: DataFrame) -> DataFrame:
    # Names of files are few bytes, and without a number of tasks AQE would have one task read all of them.
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    dealt = files.select("bucket", "path", "opened").repartition(tasks, "path")
    return dealt.mapInArrow(_reader(), f"{LINES}, opened long")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below a folder, none if nothing has been written there."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def write_rolled(lines: DataFrame, path: str, batch: int, rolling: Rolling = Rolling(), now: int | None = None) -> None:
    """Add a micro-batch of lines (bucket, value); null values are left out. Written again, a batch replaces itself.

    ``now`` is the time in epoch milliseconds by which files age. A line longer than ``size`` makes its file longer than twice
    that. All files of one batch and bucket are written before any is visible.
    """
    spark = lines.sparkSession
    now = int(time.time() * 1000) if now is None else now
    # Computed once: a micro-batch with state would otherwise run for its sizes and again for its lines. Memory is for the sort below.
    fresh = lines.where("value IS NOT NULL").select("bucket", "value", F.lit(now).alias("opened")).persist(StorageLevel.DISK_ONLY)
    before = _stored(spark, f"{path}/open/batch={batch - 1}", ENTRY).drop("batch")
    alive = before.where((F.col("opened") > now - _millis(rolling.age)) & (F.col("touched") > now - _millis(rolling.idle)))
    arrived = fresh.groupBy("bucket").agg(F.sum(F.octet_length("value") + 1).alias("arrived"))
    same = F.col("bucket").eqNullSafe(F.col("_bucket"))
    plan = alive.groupBy("bucket").agg(F.sum("bytes").alias("held"))
    plan = arrived.join(plan.withColumnRenamed("bucket", "_bucket"), same, "left").drop("_bucket")
    spread = F.greatest(F.lit(1).cast("long"), (F.col("arrived") + F.coalesce("held", F.lit(0))) / F.lit(FILES_PER_TASK * rolling.size)).cast("long")
    plan = plan.select(F.col("bucket").alias("_bucket"), spread.alias("_spread")).persist()
    try:
        taken = alive.join(plan, same, "left_semi")
        every_line = fresh.unionByName(_lines_of(taken))
        # Lines are never the side that is broadcast, whatever Spark takes their size for; large buckets are one per FILES_PER_TASK files.
        large = F.broadcast(plan.where("_spread > 1"))
        dealt = every_line.withColumn("_deal", F.xxhash64("value", F.monotonically_increasing_id())).join(large, same, "left")
        dealt = dealt.select("bucket", F.pmod("_deal", F.coalesce("_spread", F.lit(1))).alias("part"), "opened", "value")
        dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        added = dealt.mapInArrow(_writer(f"{path}/files", rolling.size, now), ENTRY).withColumn("added", F.lit(True))
        log = f"{path}/log/batch={batch}"
        added.unionByName(taken.withColumn("added", F.lit(False))).write.mode("overwrite").parquet(log)
        written = spark.read.schema(LOG).parquet(log).where("added").drop("added")
        small = written.where(F.col("bytes") < rolling.size).unionByName(alive.join(plan, same, "left_anti"))
        small.write.mode("overwrite").parquet(f"{path}/open/batch={batch}")
    finally:
        plan.unpersist()
        fresh.unpersist()


def start_rolled(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict[str, object],
    rolling: Rolling = Rolling(),
    name: str | None = None,
) -> StreamingQuery:
    """Write a stream of lines (bucket, value) below ``path``; ``read_rolled`` reads them."""
    writer = lines.writeStream.foreachBatch(lambda batch, number: write_rolled(batch, path, number, rolling))
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()


def files_of(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The files that hold the lines, as they were after micro-batch ``until``, by default after the last one that ended."""
    log = _stored(spark, f"{path}/log", LOG)
    if until is not None:
        log = log.where(F.col("batch") <= until)
    gone = log.where("NOT added").select("path")
    return log.where("added").join(gone, "path", "left_anti").drop("added")


def read_rolled(spark: SparkSession, path: str, until: int | None = None, where: Column | None = None) -> DataFrame:
    """bucket, value of every line; a condition ``where`` on ``bucket`` picks files before they are read."""
    files = files_of(spark, path, until)
    return _lines_of(files if where is None else files.where(where)).select("bucket", "value")


def fork_rolled(spark: SparkSession, path: str, target: str, batch: int) -> None:
    """Let ``target`` start with what ``path`` held after micro-batch ``batch``. Files are shared, only the log is copied."""
    log = _stored(spark, f"{path}/log", LOG)
    log.where(F.col("batch") <= batch).write.partitionBy("batch").parquet(f"{target}/log")
    _stored(spark, f"{path}/open", ENTRY).where(F.col("batch") == batch).drop("batch").write.parquet(f"{target}/open/batch={batch}")
