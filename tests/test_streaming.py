import random
import time
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from winfleet.operators.state import status_changes
from winfleet.operators.windows import average_temperature
from winfleet.sources.sensor import event_stream, generate_stream, generate_table, sensor_rows, with_watermark
from winfleet.streaming.fleet import (
    compact_latest_state,
    drop_old_runs,
    read_latest_state,
    read_status_changes,
    runs_after,
    start_latest_state,
    start_status_changes,
)
from winfleet.streaming.jobs import JobSettings, job_output, start_average_job, start_maximum_job
from winfleet.streaming.rolling import read_rolled
from winfleet.streaming.sinks import bucket_counts, every, read_buckets, sensor_lines, window_lines, write_buckets

START = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"
SMALL = {"size": timedelta(seconds=60), "slide": timedelta(seconds=10), "lateness": timedelta(seconds=5), "interval": None}


class Folder:
    """Files that are added one by one, each in a folder of its own, and taken in that order by a stream over all of them."""

    def __init__(self, spark, base, schema):
        self.spark, self.base, self.schema, self.n = spark, base / "in", schema, 0
        self.path = f"{self.base}/*"
        self.base.mkdir()

    def add(self, rows):
        self.n += 1
        time.sleep(0.02)  # files are taken by modification time
        self.frame(rows).coalesce(1).write.parquet(f"{self.base}/{self.n:03}")

    def frame(self, rows):
        return self.spark.createDataFrame(rows, self.schema)

    def stream(self, files_per_trigger=1):
        return event_stream(self.spark, self.path, self.frame([]).schema, files_per_trigger)


def events(*offsets, user=1):
    return [(i, START + timedelta(seconds=s), user, 20.0 + i) for i, s in enumerate(offsets)]


def finish(queries):
    for running in queries:
        running.awaitTermination()
    return queries


def lines(spark, path):
    return sorted(r.value for r in read_rolled(spark, path).collect())


def starts_of(spark, path):
    return [line[11:19] for line in lines(spark, path)]


def test_late_rows_reach_their_open_windows_only(spark, tmp_path):
    folder = Folder(spark, tmp_path, EVENTS)
    for offsets in ([5, 80], [20], [600]):
        folder.add(events(*offsets))
    job = finish(start_maximum_job(sensor_rows(folder.stream()), str(tmp_path / "out"), str(tmp_path / "cp"), **SMALL))
    dropped = sum(op.numRowsDroppedByWatermark for p in job[1].recentProgress for op in p.stateOperators)
    assert dropped == 5
    got = [line.split(",") for line in lines(spark, job_output(str(tmp_path / "out"), "run", "maximum"))]
    values = {start[11:19]: value for start, _, value in got}
    # The watermark stands at 75 s when the row of second 20 arrives: of its windows only [20, 80) is still open.
    assert values["00:00:20"] == "20.000000"
    first = [s for s in values if s < "00:00:20"] + [f"23:59:{s}" for s in (10, 20, 30, 40, 50) if f"23:59:{s}" in values]
    assert all(values[s] == "20.000000" for s in first)
    assert len(read_rolled(spark, job_output(str(tmp_path / "out"), "run", "sensor")).collect()) == 4


def test_stream_equals_closed_windows_of_the_table(spark, tmp_path):
    table = generate_table(spark, 3000, keys=7, delays=[1700, 300], delay_interval=60_000).select(
        F.col("event_id"), F.col("event_time").alias("ts"), F.col("location_id").alias("user_id"), F.col("temperature").cast("double").alias("value")
    )
    folder = Folder(spark, tmp_path, table.schema)
    parts = table.orderBy("ts").collect()
    for i in range(0, len(parts), 600):
        folder.add(parts[i:i + 600])
    job = finish(start_average_job(sensor_rows(folder.stream()), str(tmp_path / "out"), str(tmp_path / "cp"), **SMALL))
    assert len(job) == 2
    rows = sensor_rows(spark.read.schema(table.schema).parquet(folder.path))
    windows = average_temperature(rows, SMALL["size"], SMALL["slide"])
    last = rows.agg(F.max("event_time")).first()[0]
    closed = windows.where(F.col("window_start") + F.lit(SMALL["size"]) <= F.lit(last - SMALL["lateness"]))
    expected = sorted(r.value for r in window_lines(closed).collect())
    assert expected and lines(spark, job_output(str(tmp_path / "out"), "run", "average")) == expected
    assert lines(spark, job_output(str(tmp_path / "out"), "run", "sensor")) == sorted(r.value for r in sensor_lines(rows).collect())


def test_restart_continues_and_a_new_run_starts_over(spark, tmp_path):
    folder = Folder(spark, tmp_path, EVENTS)
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(name):
        finish(start_maximum_job(sensor_rows(folder.stream()), out, checkpoints, name, **SMALL))
        return starts_of(spark, job_output(out, name, "maximum")), lines(spark, job_output(out, name, "sensor"))

    folder.add(events(0, 70))
    first, _ = run("a")
    folder.add(events(75, 300))
    second, rows = run("a")
    assert set(first) < set(second) and max(Counter(second).values()) == 1 and len(rows) == 4
    third, rows_again = run("a")
    assert (third, rows_again) == (second, rows)
    assert run("b") == (second, rows)


def test_console_follows_verbosity(spark, tmp_path):
    folder = Folder(spark, tmp_path, EVENTS)
    folder.add(events(0, 100))
    for verbosity, expected in ((0, 2), (1, 3), (2, 4)):
        settings = {**SMALL, "console_verbosity": verbosity}
        base = tmp_path / str(verbosity)
        assert len(finish(start_average_job(sensor_rows(folder.stream()), str(base / "o"), str(base / "c"), **settings))) == expected


def test_settings_and_triggers():
    assert JobSettings().size == timedelta(hours=1) and JobSettings().lateness == timedelta(minutes=1)
    assert every(None) == {"availableNow": True}
    assert every(timedelta(seconds=1.5)) == {"processingTime": "1500 milliseconds"}


def test_stream_keeps_the_late_filter_setting(spark, tmp_path):
    name = "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(name)
    folder = Folder(spark, tmp_path, EVENTS)
    folder.add(events(0))
    finish(start_average_job(sensor_rows(folder.stream()), str(tmp_path / "o"), str(tmp_path / "c"), **SMALL))
    assert spark.conf.get(name) == before


def test_generated_stream_has_the_sensor_schema(spark):
    stream = with_watermark(generate_stream(spark, 5, keys=3))
    assert stream.isStreaming and stream.columns == ["event_id", "event_time", "location_id", "temperature"]


def test_bucket_folders(spark, tmp_path):
    rows = sensor_rows(spark.createDataFrame(events(*range(0, 7200, 60)), EVENTS))
    path = str(tmp_path / "buckets")
    write_buckets(sensor_lines(rows), path, rows_per_file=20)
    assert sorted(p.name for p in (tmp_path / "buckets").glob("bucket=*")) == ["bucket=2024-01-01--00", "bucket=2024-01-01--01"]
    files = list((tmp_path / "buckets").glob("bucket=*/part-*"))
    assert len(files) == 6 and all(len(f.read_text().splitlines()) == 20 for f in files)
    counted = {r.bucket: r.n for r in bucket_counts(read_buckets(spark, path)).collect()}
    assert counted == {"2024-01-01--00": 60, "2024-01-01--01": 60}
    first = (tmp_path / "buckets" / "bucket=2024-01-01--00").glob("part-*")
    assert "2024-01-01T00:00:00.000Z,0,1,20.00" in "".join(f.read_text() for f in first)


CHANGES = "seq bigint, name string, op string, payload int"


def test_streamed_latest_state_with_resets_inside_batches(spark, tmp_path, rows_of):
    folder = Folder(spark, tmp_path, CHANGES)
    batches = [
        [(1, "a", "CHANGED", 1), (2, "b", "CHANGED", 2)],
        [(6, "c", "CHANGED", 6), (4, "a", "CHANGED", 4), (5, "", "RESET", 0), (3, "b", "DELETED", 0)],
        [(7, "c", "CHANGED", 7), (8, "d", "CHANGED", 8), (9, "d", "DELETED", 0), (10, "a", "DELETED", 0)],
    ]
    expected = [
        [batches[0][0], batches[0][1]],
        [batches[1][0]],
        [batches[2][0]],
    ]
    path, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")
    for batch, live in zip(batches, expected):
        folder.add(batch)
        start_latest_state(folder.stream(), path, checkpoint, ["name"]).awaitTermination()
        assert rows_of(read_latest_state(spark, path, folder.frame([]).schema, ["name"])) == sorted(live, key=repr)


def test_compacted_state_goes_on_elsewhere(spark, tmp_path, rows_of):
    folder = Folder(spark, tmp_path, CHANGES)
    schema, checkpoint = folder.frame([]).schema, str(tmp_path / "cp")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for batch in ([(1, "a", "CHANGED", 1), (2, "b", "CHANGED", 2)], [(3, "a", "CHANGED", 3), (4, "c", "DELETED", 0)]):
        folder.add(batch)
        start_latest_state(folder.stream(), old, checkpoint, ["name"]).awaitTermination()
    compact_latest_state(spark, old, new, schema, ["name"])
    assert spark.read.parquet(new).count() == 3
    folder.add([(5, "b", "DELETED", 0), (6, "d", "CHANGED", 6)])
    start_latest_state(folder.stream(), new, checkpoint, ["name"]).awaitTermination()
    assert rows_of(read_latest_state(spark, new, schema, ["name"])) == [(3, "a", "CHANGED", 3), (6, "d", "CHANGED", 6)]


def test_replayed_batch_replaces_itself(spark, tmp_path, rows_of):
    folder = Folder(spark, tmp_path, CHANGES)
    folder.add([(1, "a", "CHANGED", 1), (2, "b", "CHANGED", 2)])
    path = str(tmp_path / "state")
    for checkpoint in ("lost", "fresh"):  # a lost checkpoint replays batch 0
        start_latest_state(folder.stream(), path, str(tmp_path / checkpoint), ["name"]).awaitTermination()
    assert spark.read.parquet(path).count() == 2


def plain_state(log):
    live = {}
    for seq, name, op, payload in sorted(log):
        if op == "RESET":
            live.clear()
        elif op == "DELETED":
            live.pop(name, None)
        else:
            live[name] = (seq, name, op, payload)
    return sorted(live.values(), key=repr)


@pytest.mark.parametrize("in_order,n", [(False, 40), (True, 15)])
def test_streamed_state_stays_compact(spark, tmp_path, rows_of, in_order, n):
    """Many micro-batches over forty names: rows stay within a small factor of the names, every list of runs gives its batch's state."""
    rng = random.Random(3)
    folder = Folder(spark, tmp_path, CHANGES)
    log, ends = [], []
    for _ in range(n):
        rows = [(len(log) + i, f"n{rng.randrange(40)}", rng.choice(["CHANGED"] * 5 + ["DELETED"]), i) for i in range(rng.randrange(1, 12))]
        if rng.random() < 0.05:
            rows[0] = (rows[0][0], "", "RESET", 0)
        rng.shuffle(rows)
        log += rows
        ends.append(len(log))
        folder.add(rows)
    path, schema = str(tmp_path / "state"), folder.frame([]).schema
    start_latest_state(folder.stream(), path, str(tmp_path / "cp"), ["name"], in_order=in_order).awaitTermination()
    for batch in (0, 1, 7, n // 2, n - 1):
        assert rows_of(read_latest_state(spark, path, schema, ["name"], batch=batch)) == plain_state(log[: ends[batch]])
    sizes = [runs_after(path, batch)[1] for batch in range(n)]
    assert max(sum(rows for _, rows in runs) for runs in sizes) <= 2 * 41
    assert max(map(len, sizes)) <= 6 and sizes[-1][0][0] > 0
    reader = read_latest_state(spark, path, schema, ["name"])
    gone = drop_old_runs(path, keep=1)
    assert gone and rows_of(reader) == plain_state(log)
    assert {int(f.name.removeprefix("batch=")) for f in (tmp_path / "state").glob("batch=*")} == {run for run, _ in sizes[-1]}
    folder.add([(10**6, "n1", "CHANGED", 7)])
    start_latest_state(folder.stream(), path, str(tmp_path / "cp"), ["name"], in_order=in_order).awaitTermination()
    assert rows_of(read_latest_state(spark, path, schema, ["name"])) == plain_state([*log, (10**6, "n1", "CHANGED", 7)])


def test_rows_that_come_after_later_ones_change_nothing(spark, tmp_path, rows_of):
    folder = Folder(spark, tmp_path, CHANGES)
    for rows in ([(9, "a", "DELETED", 0)], [(5, "a", "CHANGED", 1), (6, "b", "CHANGED", 2)], [(7, "", "RESET", 0)], [(3, "c", "CHANGED", 3), (8, "d", "CHANGED", 4)]):
        folder.add(rows)
    path = str(tmp_path / "state")
    start_latest_state(folder.stream(), path, str(tmp_path / "cp"), ["name"]).awaitTermination()
    assert rows_of(read_latest_state(spark, path, folder.frame([]).schema, ["name"])) == [(8, "d", "CHANGED", 4)]


STATUS = "seq bigint, ts timestamp_ntz, key string, status string"


@pytest.mark.parametrize("remembered", [timedelta(minutes=5), timedelta(milliseconds=1), timedelta(days=9)])
def test_streamed_status_changes_are_the_table_s(spark, tmp_path, rows_of, remembered):
    folder = Folder(spark, tmp_path, STATUS)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [
        [(3, 3, "a", "y"), (1, 1, "a", "x"), (2, 2, "a", "x"), (4, 4, "b", "x")],
        [(5, 5, "a", "y"), (6, 6, "b", "y")],
        [(7, 400, "a", "y"), (8, 401, "b", "x"), (9, 402, "c", "x"), (10, 90_000, "c", "x")],
        [(11, 90_001, "a", "z"), (12, 90_002, "a", "y")],
    ]
    log = []
    for batch in batches:
        rows = [(seq, START + timedelta(seconds=s), key, status) for seq, s, key, status in batch]
        log += rows
        folder.add(rows)
        start_status_changes(folder.stream(), path, checkpoint, "key", remembered=remembered).awaitTermination()
        expected = rows_of(status_changes(folder.frame(log), "key", remembered=remembered))
        assert rows_of(read_status_changes(spark, path, folder.frame([]).schema)) == expected


def test_replayed_status_batches_replace_themselves(spark, tmp_path):
    folder = Folder(spark, tmp_path, STATUS)
    folder.add([(1, START, "a", "x")])
    folder.add([(2, START + timedelta(seconds=1), "a", "y")])
    for checkpoint in ("lost", "fresh"):
        start_status_changes(folder.stream(), str(tmp_path / "out"), str(tmp_path / checkpoint), "key").awaitTermination()
    assert read_status_changes(spark, str(tmp_path / "out"), folder.frame([]).schema).count() == 2


def test_decimal_lines(spark):
    frame = spark.createDataFrame([("k", START, Decimal("20.50"))], "location_id string, window_start timestamp_ntz, temperature decimal(18,2)")
    assert window_lines(frame).first() == ("2024-01-01T00:00:00.000Z,k,20.50", "2024-01-01--00")
