import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from winfleet.sources.sensor import event_stream, sensor_rows
from winfleet.streaming import fanout
from winfleet.streaming.fanout import start_fanout_job
from winfleet.streaming.jobs import job_output, start_average_job, start_maximum_job
from winfleet.streaming.rolling import read_rolled

START = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value decimal(8,2)"
SMALL = {"size": timedelta(seconds=60), "slide": timedelta(seconds=10), "lateness": timedelta(seconds=5), "interval": None}


@pytest.fixture
def arrivals(spark, tmp_path):
    """Five files of disordered events: late ones, a silent key, a file without rows, rows without time or value."""
    source = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    n = 0

    def add(rows):
        nonlocal n
        n += 1
        spark.createDataFrame([(i, t, u, v if v is None else Decimal(v) / 100) for i, t, u, v in rows], EVENTS).coalesce(1).write.parquet(f"{folder}/{n:03}")

    def some(k, late=0):
        times = [100 * k + source.randint(-late, 100) for _ in range(60)]
        return [(1000 * k + i, START + timedelta(seconds=t), source.choice([1, 1, 2, None]), source.randint(-999, 999)) for i, t in enumerate(times)]

    parts = [some(0), some(1, 120), [], some(2, 300), [(1, None, 1, 1), (2, START + timedelta(seconds=900), 1, None), (3, START, 9, 5)]]
    return folder, parts, add


def lines(spark, output, part):
    return Counter(tuple(row) for row in read_rolled(spark, job_output(str(output), "run", part)).collect())


def stream(spark, folder):
    frame = spark.createDataFrame([], EVENTS)
    return sensor_rows(event_stream(spark, f"{folder}/*", frame.schema, 1))


@pytest.mark.parametrize("part,slide", [("maximum", 10), ("average", 25)])
def test_one_query_writes_what_two_queries_write(spark, tmp_path, arrivals, part, slide):
    folder, parts, add = arrivals
    settings = SMALL | {"slide": timedelta(seconds=slide)}
    read = 0
    for some in (parts[:3], parts[3:]):
        for rows in some:
            add(rows)
        one = start_fanout_job(stream(spark, folder), str(tmp_path / "one"), str(tmp_path / "progress"), part=part, **settings)
        one.awaitTermination()
        read += sum(progress.numInputRows for progress in one.recentProgress)
        start = {"average": start_average_job, "maximum": start_maximum_job}[part]
        for query in start(stream(spark, folder), str(tmp_path / "two"), str(tmp_path / "progress-two"), **settings):
            query.awaitTermination()
    assert read == sum(map(len, parts))  # each row counts once: the source is scanned once for both sinks
    assert lines(spark, tmp_path / "one", "sensor") == lines(spark, tmp_path / "two", "sensor")
    windows = lines(spark, tmp_path / "one", part)
    assert windows == lines(spark, tmp_path / "two", part) and len(windows) > 5
    state = tmp_path / "progress" / "run" / part / "state" / "panes"
    assert len(list(state.iterdir())) == fanout.KEPT


def test_a_failure_between_the_sinks_leaves_no_gap_and_no_double(spark, tmp_path, arrivals, monkeypatch):
    folder, parts, add = arrivals
    for rows in parts:
        add(rows)
    job = lambda name: start_fanout_job(stream(spark, folder), str(tmp_path / name), str(tmp_path / f"progress-{name}"), **SMALL)
    job("whole").awaitTermination()
    right, calls = fanout.write_rolled, []

    def failing(frame, path, number, rolling):
        calls.append(number)
        if len(calls) in (4, 7):  # once before the windows of the second micro-batch, once before its rows when it ran again
            raise RuntimeError("lost")
        right(frame, path, number, rolling)

    monkeypatch.setattr(fanout, "write_rolled", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            job("broken").awaitTermination()
    job("broken").awaitTermination()
    for part in ("sensor", "average"):
        assert lines(spark, tmp_path / "broken", part) == lines(spark, tmp_path / "whole", part)


def test_gaps_between_windows_are_refused(spark, tmp_path, arrivals):
    with pytest.raises(ValueError):
        start_fanout_job(stream(spark, arrivals[0]), "out", "progress", size=timedelta(seconds=5), slide=timedelta(seconds=10))
