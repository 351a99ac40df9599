"""Streams whose state are the open panes of sliding windows: late rows, restarts, failures, forks, and how much they hold."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import EVENTS, SMALL, START, Folder, events, finish, lines

from winfleet.operators.windows import average_temperature, maximum_temperature
from winfleet.sources.sensor import sensor_rows
from winfleet.streaming import jobs
from winfleet.streaming.jobs import JobSettings, fork_job, job_batches, job_output, start_average_job, start_maximum_job
from winfleet.streaming.savepoints import saved_batches, state_at, watermark_of
from winfleet.streaming.sinks import window_lines

DOZEN = SMALL | {"slide": timedelta(seconds=5)}  # a row is in twelve windows, as in jobs with their usual settings
JOBS = {"average": (start_average_job, average_temperature), "maximum": (start_maximum_job, maximum_temperature)}


def closed(spark, parts, part, settings):
    rows = sensor_rows(spark.createDataFrame([r for rows in parts for r in rows], EVENTS))
    windows = JOBS[part][1](rows, settings["size"], settings["slide"])
    last = rows.agg(F.max("event_time")).first()[0]
    return sorted(r.value for r in window_lines(windows.where(F.col("window_start") + F.lit(settings["size"]) <= F.lit(last - settings["lateness"]))).collect())


@pytest.mark.parametrize("part", JOBS)
def test_a_row_in_a_dozen_windows_is_one_row_of_state(spark, tmp_path, part):
    """Windows as state were twelve rows for each of these, in the memory of executors."""
    folder = Folder(spark, tmp_path, EVENTS)
    parts = [[(i, START + timedelta(seconds=20 * i), i % 7, float(i)) for i in range(100)]]
    folder.add(parts[0])
    finish(JOBS[part][0](sensor_rows(folder.stream()), str(tmp_path / "out"), str(tmp_path / "cp"), **DOZEN))
    checkpoint = str(tmp_path / "cp" / "run" / part / "windows")
    assert saved_batches(checkpoint) == [0, 1]
    assert [state_at(spark, checkpoint, n).count() for n in (0, 1)] == [100, 4]  # 1,975 s have passed; the last four panes are open
    assert watermark_of(checkpoint, 0) == 0 and watermark_of(checkpoint, 1) == 1000 * (int(START.timestamp()) + 1975)
    assert "RocksDBStateStoreProvider" in (tmp_path / "cp" / "run" / part / "windows" / "offsets" / "0").read_text()
    assert lines(spark, job_output(str(tmp_path / "out"), "run", part)) == closed(spark, parts, part, DOZEN)


@pytest.mark.parametrize("part,size,slide", [("average", 60, 7), ("maximum", 60, 5)])
def test_panes_as_state_write_what_windows_as_state_write(spark, tmp_path, part, size, slide):
    """Disordered rows, late ones among them, a file without rows, missing keys, times and values, a restart."""
    rng = random.Random(size + slide)
    settings = SMALL | {"size": timedelta(seconds=size), "slide": timedelta(seconds=slide)}

    def some(k, late):
        return [(100 * k + i, START + timedelta(milliseconds=rng.randint(100_000 * k - late, 100_000 * (k + 1))), rng.choice([1, 1, 2, None]), rng.randint(-999, 999) / 100) for i in range(50)]

    folder = Folder(spark, tmp_path, EVENTS)
    for some_parts in ([some(0, 0), []], [some(2, 250_000), [(1, None, 1, 1.0), (2, START + timedelta(seconds=900), 1, None), (3, START, 9, 5.0)], some(4, 90_000)]):
        for rows in some_parts:
            folder.add(rows)
        for panes in (True, False):
            finish(JOBS[part][0](sensor_rows(folder.stream()), str(tmp_path / f"out-{panes}"), str(tmp_path / f"cp-{panes}"), panes=panes, **settings))
        got = [lines(spark, job_output(str(tmp_path / f"out-{panes}"), "run", part)) for panes in (True, False)]
        assert got[0] == got[1]
    assert len(got[0]) > 20


def test_a_failure_before_the_state_or_after_the_lines_changes_nothing(spark, tmp_path, monkeypatch):
    folder = Folder(spark, tmp_path, EVENTS)
    parts = [events(*range(k, k + 100, 9), user=k % 3) for k in (0, 90)]
    for part in parts:
        folder.add(part)
    right, calls = jobs.write_rolled, []

    def failing(frame, path, number, rolling):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost")
        right(frame, path, number, rolling)
        if len(calls) == 4:
            raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "write_rolled", failing)
    for ends in (False, False, True):
        queries = start_average_job(sensor_rows(folder.stream()), str(tmp_path / "out"), str(tmp_path / "cp"), **DOZEN)
        queries[0].awaitTermination()
        if ends:
            queries[1].awaitTermination()
        else:
            with pytest.raises(Exception, match="lost"):
                queries[1].awaitTermination()
    assert lines(spark, job_output(str(tmp_path / "out"), "run", "average")) == closed(spark, parts, "average", DOZEN)


def test_a_fork_takes_the_panes_of_its_state(spark, tmp_path):
    parts = [events(*range(0, 120, 7)), events(*range(125, 240, 5), user=2), events(250, 400, user=1)]
    other = events(235, 241, 300, 700, user=2)
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "cp")
    folder, saved = Folder(spark, tmp_path, EVENTS), []
    for part in parts:
        folder.add(part)
        finish(start_average_job(sensor_rows(folder.stream()), out, checkpoints, "a", **DOZEN))
        saved.append({q: b[-1] for q, b in job_batches(checkpoints, "a", "average").items()})
    (tmp_path / "second").mkdir()
    elsewhere = Folder(spark, tmp_path / "second", EVENTS)
    elsewhere.add(other)
    fork_job(spark, out, checkpoints, "a", "b", "average", saved[1])
    old, new = (f"{checkpoints}/{run}/average/windows" for run in "ab")
    held = [sorted(map(repr, state_at(spark, c, saved[1]["windows"]).select("key", "value").collect())) for c in (old, new)]
    assert held[0] == held[1] and 0 < len(held[0]) < 20  # panes of the last minute
    assert lines(spark, job_output(out, "b", "average")) == closed(spark, parts[:2], "average", DOZEN)
    finish(start_average_job(sensor_rows(elsewhere.stream()), out, checkpoints, "b", **DOZEN))
    assert lines(spark, job_output(out, "b", "average")) == closed(spark, [*parts[:2], other], "average", DOZEN)
    assert lines(spark, job_output(out, "a", "average")) == closed(spark, parts, "average", DOZEN)


def test_panes_are_of_windows_without_gaps(spark, tmp_path):
    assert JobSettings().panes is None
    with pytest.raises(ValueError, match="gaps"):
        start_average_job(sensor_rows(Folder(spark, tmp_path, EVENTS).stream()), "out", "cp", panes=True, size=timedelta(seconds=5), slide=timedelta(seconds=6))
