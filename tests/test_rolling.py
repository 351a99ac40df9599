"""Files that roll by size, age and idleness, saved states that a stream can start from, and status changes with keyed state."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_streaming import EVENTS, SMALL, STATUS, START, Folder, events, finish, lines

from winfleet.operators.state import status_changes
from winfleet.operators.windows import average_temperature
from winfleet.sources.sensor import sensor_rows
from winfleet.streaming.jobs import fork_job, job_batches, job_output, start_average_job
from winfleet.streaming.keyed import keyed_silences, keyed_status_changes, start_keyed
from winfleet.streaming.rolling import Rolling, _reader, _writer, files_of, fork_rolled, read_rolled, write_rolled
from winfleet.streaming.savepoints import fork_checkpoint, saved_batches, state_at
from winfleet.streaming.sinks import window_lines

LINES = "bucket string, value string"
ROLLING = Rolling(size=1000, age=timedelta(seconds=60), idle=timedelta(seconds=20))


def held(spark, path, until=None):
    return Counter(tuple(r) for r in read_rolled(spark, path, until).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, LINES).repartition(5)


def files(spark, path):
    return sorted((r.bucket or "", r.bytes) for r in files_of(spark, path).collect())


def test_files_have_their_size_whenever_the_lines_allow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("winfleet.streaming.rolling.FILES_PER_TASK", 4)  # a large bucket is dealt to several tasks
    rng = random.Random(1)
    rows = [(b, "x" * rng.randrange(1, 60)) for b, n in (("hot", 3000), ("some", 90), ("few", 4), (None, 50)) for _ in range(n)]
    path = str(tmp_path / "a")
    write_rolled(frame(spark, rows + [("hot", None)] * 5), path, 0, ROLLING)
    assert held(spark, path) == Counter(rows)
    per_bucket = Counter(b for b, _ in files(spark, path))
    total = Counter()
    for bucket, value in rows:
        total[bucket or ""] += len(value) + 1
    for bucket, size in files(spark, path):
        assert size < 2 * 1000 + 60 and (size >= 1000 or total[bucket] < 1000)
    assert per_bucket["few"] == 1 and per_bucket["hot"] > 30
    for r in files_of(spark, path).collect():
        with open(r.path.removeprefix("file://"), "rb") as file:
            data = file.read()
        assert len(data) == r.bytes and data.count(b"\n") == r.lines


def test_open_files_grow_and_close_by_size_age_and_idleness(spark, tmp_path):
    path, wrote = str(tmp_path / "a"), []

    def add(batch, second, rows):
        wrote.extend(rows)
        write_rolled(frame(spark, rows), path, batch, ROLLING, now=second * 1000)
        assert held(spark, path) == Counter(wrote)
        return files(spark, path)

    assert add(0, 0, [("a", "x" * 399), ("b", "y" * 99)]) == [("a", 400), ("b", 100)]
    assert add(1, 10, [("a", "z" * 399)]) == [("a", 800), ("b", 100)]
    assert add(2, 15, [("a", "w" * 399), ("b", "v" * 99)]) == [("a", 1200), ("b", 200)]  # a is full
    assert add(3, 25, [("a", "q" * 9)]) == [("a", 10), ("a", 1200), ("b", 200)]
    assert add(4, 40, [("b", "r" * 9)]) == [("a", 10), ("a", 1200), ("b", 10), ("b", 200)]  # b was idle for 20 s
    assert add(5, 41, []) == [("a", 10), ("a", 1200), ("b", 10), ("b", 200)]
    for batch, second in ((6, 55), (7, 70), (8, 85), (9, 99)):
        add(batch, second, [("b", "s" * 9)])
    assert files(spark, path)[2:] == [("b", 50), ("b", 200)]
    assert add(10, 101, [("b", "t" * 9)])[2:] == [("b", 10), ("b", 50), ("b", 200)]  # 60 s after it was opened
    assert held(spark, path, until=1) == Counter(wrote[:3])


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "a")
    write_rolled(frame(spark, [("a", "1"), ("a", "2")]), path, 0, ROLLING, now=0)
    for again in range(3):
        write_rolled(frame(spark, [("a", "3"), ("b", "4")]), path, 1, ROLLING, now=again)
        assert held(spark, path) == Counter([("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")])
        assert files(spark, path) == [("a", 6), ("b", 2)]
    fork_rolled(spark, path, str(tmp_path / "b"), 0)
    write_rolled(frame(spark, [("a", "5")]), str(tmp_path / "b"), 1, ROLLING, now=1)
    assert held(spark, str(tmp_path / "b")) == Counter([("a", "1"), ("a", "2"), ("a", "5")])
    assert held(spark, path) == Counter([("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")])


def test_a_failed_batch_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "a")
    write_rolled(frame(spark, [("a", "1")]), path, 0, ROLLING, now=0)
    broken = frame(spark, [("a", "2"), ("a", "3")]).withColumn("value", F.when(F.col("value") == "3", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_rolled(broken, path, 1, ROLLING, now=1)
    assert held(spark, path) == Counter([("a", "1")])
    write_rolled(frame(spark, [("a", "2"), ("a", "3")]), path, 1, ROLLING, now=2)
    assert held(spark, path) == Counter([("a", "1"), ("a", "2"), ("a", "3")])


def closed_windows(spark, parts):
    rows = sensor_rows(spark.createDataFrame([r for part in parts for r in part], EVENTS))
    windows = average_temperature(rows, SMALL["size"], SMALL["slide"])
    last = rows.agg(F.max("event_time")).first()[0]
    closed = windows.where(F.col("window_start") + F.lit(SMALL["size"]) <= F.lit(last - SMALL["lateness"]))
    return sorted(r.value for r in window_lines(closed).collect())


def test_fork_goes_on_from_a_chosen_state(spark, tmp_path):
    parts = [events(*range(0, 120, 7)), events(*range(125, 240, 5), user=2), events(250, 400, user=1)]
    other = events(245, 300, 700, user=2)
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "cp")
    folder = Folder(spark, tmp_path, EVENTS)
    saved = []
    for part in parts:
        folder.add(part)
        finish(start_average_job(sensor_rows(folder.stream()), out, checkpoints, "a", **SMALL))
        assert lines(spark, job_output(out, "a", "average")) == closed_windows(spark, [*parts[: len(saved)], part])
        saved.append({q: b[-1] for q, b in job_batches(checkpoints, "a", "average").items()})
    (tmp_path / "second").mkdir()
    elsewhere = Folder(spark, tmp_path / "second", EVENTS)
    elsewhere.add(other)
    for name, chosen, before in (("b", saved[1], parts[:2]), ("c", saved[0], parts[:1])):
        fork_job(spark, out, checkpoints, "a", name, "average", chosen)
        assert lines(spark, job_output(out, name, "average")) == closed_windows(spark, before)
        finish(start_average_job(sensor_rows(elsewhere.stream()), out, checkpoints, name, **SMALL))
        assert lines(spark, job_output(out, name, "average")) == closed_windows(spark, [*before, other])
        assert len(lines(spark, job_output(out, name, "sensor"))) == sum(map(len, before)) + len(other)
    # The first run is as it was, and goes on.
    folder.add(events(900, user=3))
    finish(start_average_job(sensor_rows(folder.stream()), out, checkpoints, "a", **SMALL))
    assert lines(spark, job_output(out, "a", "average")) == closed_windows(spark, [*parts, events(900, user=3)])


def test_unknown_batches_fail(spark, tmp_path):
    folder = Folder(spark, tmp_path, EVENTS)
    folder.add(events(0, 100))
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "cp")
    finish(start_average_job(sensor_rows(folder.stream()), out, checkpoints, "a", **SMALL))
    known = saved_batches(f"{checkpoints}/a/average/windows")
    assert known == [0, 1]  # the rows, and the step of the watermark after them
    assert state_at(spark, f"{checkpoints}/a/average/windows", 0).count() > state_at(spark, f"{checkpoints}/a/average/windows", 1).count() > 0
    for batch in (2, -1, 99):
        with pytest.raises(ValueError, match="no saved state"):
            fork_checkpoint(spark, f"{checkpoints}/a/average/windows", str(tmp_path / f"fork{batch}"), batch)
        with pytest.raises(ValueError, match="no saved state"):
            fork_job(spark, out, checkpoints, "a", "b", "average", {"rows": 0, "windows": batch})
    assert saved_batches(str(tmp_path / "nothing")) == []
    fork_checkpoint(spark, f"{checkpoints}/a/average/windows", str(tmp_path / "taken"), 1)
    with pytest.raises(ValueError, match="exists"):
        fork_checkpoint(spark, f"{checkpoints}/a/average/windows", str(tmp_path / "taken"), 1)


def status_rows(rng, n, hot=0.4):
    return [
        (i, START + timedelta(milliseconds=rng.randrange(0, 4_000_000)), "hot" if rng.random() < hot else f"k{rng.randrange(6)}", rng.choice("xyz"))
        for i in range(n)
    ]


@pytest.mark.parametrize("remembered", [timedelta(seconds=5), timedelta(seconds=200)])
def test_keyed_changes_equal_the_table_s_in_any_order_within_lateness(spark, tmp_path, remembered):
    rng = random.Random(4)
    lateness = timedelta(seconds=300)
    rows = sorted(status_rows(rng, 900), key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 250)))
    folder = Folder(spark, tmp_path, STATUS)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(0, 900, 225):  # four runs: the state outlives each
        folder.add(rows[k : k + 225])
        changes = keyed_status_changes(folder.stream(), "key", remembered=remembered, lateness=lateness)
        start_keyed(changes, path, checkpoint).awaitTermination()
        seen = max(r[1] for r in rows[: k + 225]) - lateness
        wanted = status_changes(folder.frame(rows[: k + 225]), "key", remembered=remembered).where(F.col("ts") <= F.lit(seen - timedelta(milliseconds=1)))
        got = spark.read.schema(changes.schema).parquet(path)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, wanted.collect()))
    assert got.count() > 100


def test_keyed_state_forgets_silent_keys_and_drops_late_rows(spark, tmp_path):
    folder = Folder(spark, tmp_path, STATUS)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    at = lambda s: START + timedelta(seconds=s)
    sizes = []
    for rows in ([(1, at(0), "a", "x"), (2, at(1), "b", "x")], [(3, at(100), "c", "x")], [(4, at(50), "a", "y"), (5, at(2000), "c", "x")], [(6, at(2100), "b", "x"), (7, datetime(2024, 1, 2), "c", "x")]):
        folder.add(rows)
        changes = keyed_status_changes(folder.stream(), "key", remembered=timedelta(seconds=500), lateness=timedelta(seconds=10))
        start_keyed(changes, path, checkpoint).awaitTermination()
        batch = saved_batches(checkpoint)[-1]
        last = spark.read.format("statestore").option("stateVarName", "last").option("batchId", batch).load(checkpoint)
        sizes.append(last.count())
    assert sorted(r.seq for r in spark.read.schema(changes.schema).parquet(path).collect()) == [1, 2, 3, 5, 6]  # 4 was too late, 7 is still held
    assert sizes == [0, 2, 0, 0]


def test_silences_are_told_once_whether_or_not_a_row_follows(spark, tmp_path):
    rng = random.Random(6)
    limit, lateness = timedelta(seconds=90), timedelta(seconds=300)
    rows = sorted(status_rows(rng, 500), key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 250)))
    rows.append((500, START + timedelta(seconds=9000), "k1", "x"))  # time goes on, and all keys are silent
    folder = Folder(spark, tmp_path, STATUS)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for upto, first in ((200, 0), (350, 200), (501, 350)):
        folder.add(rows[first:upto])
        alerts = keyed_silences(folder.stream(), "key", limit, lateness=lateness)
        start_keyed(alerts, path, checkpoint).awaitTermination()
        now = max(r[1] for r in rows[:upto]) - lateness
        wanted = []
        for key in {r[2] for r in rows[:upto]}:
            own = sorted((r for r in rows[:upto] if r[2] == key), key=lambda r: (r[1], r[0]))
            wanted += [a for a, b in zip(own, [*own[1:], None]) if (b is None or b[1] > a[1] + limit) and a[1] + limit <= now]
        assert sorted(map(tuple, spark.read.schema(alerts.schema).parquet(path).collect())) == sorted(wanted)
    assert len(wanted) > 40


def test_rows_to_come_are_held_by_columns_and_other_time_types_stay_exact(spark, tmp_path):
    """A value of state per key and row, or several, made large streams slow; thousands of rows share one."""
    for kind, zone in (("timestamp_ntz", "UTC"), ("timestamp", "UTC"), ("timestamp_ntz", "Asia/Kolkata")):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            name = f"{kind}-{zone[:3]}"
            path, checkpoint, source = (str(tmp_path / f"{name}-{x}") for x in ("out", "cp", "in"))
            schema = f"note string, seq long, ts {kind}, key string, n decimal(20,3)"
            for ids in ("id < 10000", "id >= 10000"):  # the first key has 5,000 rows, then time goes on by hours
                rows = spark.range(10_001).where(ids).selectExpr(
                    "if(id % 5 = 0, null, concat('n', id)) note", "id seq", f"cast(timestamp_micros(1704067200000007 + id * 1000 + if(id = 10000, 50000000000, 0)) as {kind}) ts",
                    "if(id < 5000, null, concat('k', id % 2)) key", "cast(id / 8 as decimal(20,3)) n",
                )
                rows.write.mode("append").parquet(source)
                stream = spark.readStream.schema(schema).parquet(source)
                start_keyed(keyed_silences(stream, "key", timedelta(hours=1)), path, checkpoint).awaitTermination()
                if ids == "id < 10000":
                    held = spark.read.format("statestore").option("stateVarName", "held").option("batchId", saved_batches(checkpoint)[-1]).load(checkpoint)
                    assert held.count() == 4  # two of a null key, one each of two others
            got = spark.read.schema(schema).parquet(path)
            assert got.columns == ["note", "seq", "ts", "key", "n"]
            wanted = spark.read.schema(schema).parquet(source).where("seq IN (4999, 9998, 9999)")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lines_are_not_broadcast_when_spark_takes_them_for_few(spark, tmp_path, monkeypatch):
    """As in a micro-batch that reads no rows and closes windows; such plans are not adaptive."""
    rows, plans, kind = [(f"b{i % 7}", "x" * 50) for i in range(100)], [], type(spark.range(1))
    apply = kind.mapInArrow

    def noted(frame, function, schema, *more, **others):
        plans.append((frame.columns, frame._jdf.queryExecution().executedPlan().toString()))
        return apply(frame, function, schema, *more, **others)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    monkeypatch.setattr("winfleet.streaming.rolling.FILES_PER_TASK", 1)
    lines = spark.createDataFrame(rows, LINES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_rolled(lines, str(tmp_path / "a"), 0, Rolling(size=100))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    (dealt,) = [plan for columns, plan in plans if "part" in columns]
    assert "BroadcastHashJoin" in dealt and "BuildLeft" not in dealt.split("InMemoryRelation")[0]
    assert held(spark, str(tmp_path / "a")) == Counter(rows)


def test_files_are_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(f"b{i % 40}", f"{i}") for i in range(400)]
    write_rolled(frame(spark, rows), path, 0, ROLLING)
    tasks = {r.t for r in read_rolled(spark, path).select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) > 4


@pytest.mark.parametrize("size,rows_per_batch,chunk", [(1, 3, 5), (50, 7, 64), (400, 1, 1 << 20), (400, 1000, 30)])
def test_writer_and_reader_cut_lines_alike_however_they_come(tmp_path, size, rows_per_batch, chunk):
    rng = random.Random(size)
    rows = [(b, p, rng.randrange(50, 150), "\u00e9\u20acx"[rng.randrange(3)] * rng.choice([0, 1, 9, 70])) for b, p, n in ((None, 0, 40), ("a", 0, 1), ("a", 1, 90), ("b", 0, 13)) for _ in range(n)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    parts = [rows[i : i + rows_per_batch] for i in range(0, len(rows), rows_per_batch)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=["bucket", "part", "opened", "value"]) for part in parts]
    (reports,) = _writer(f"file://{tmp_path}", size, 100)(iter(batches))
    read = [tuple(r.values()) for b in _reader(chunk)(iter([reports])) for r in b.to_pylist()]
    assert [(b, v) for b, v, _ in read] == [(b, v) for b, _, _, v in rows]
    whole = Counter()
    for b, p, _, v in rows:
        whole[b, p] += len(v.encode()) + 1
    start = 0
    for r in reports.to_pylist():
        mine, start = rows[start : start + r["lines"]], start + r["lines"]
        (place,) = {(b, p) for b, p, _, _ in mine}
        assert r["bytes"] == sum(len(v.encode()) + 1 for *_, v in mine) and r["bytes"] >= min(size, whole[place])
        assert r["opened"] <= min(100, *(o for _, _, o, _ in mine))
