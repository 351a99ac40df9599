import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from winfleet.operators import state
from winfleet.plans import fleet_queries  # noqa: F401  (importing registers the queries)
from winfleet.plans.registry import QUERIES

START = datetime(2024, 1, 1)


def random_log(seed, n, kinds=("job",)):
    source = random.Random(seed)
    log = []
    for seq in range(n):
        op = source.choices([state.CHANGED, state.DELETED, state.RESET], [8, 3, 0.4])[0]
        log.append((seq, source.choice(kinds), f"k{source.randint(0, 9)}", op, source.randint(0, 99)))
    return log


def replay(log):
    live = {}
    for seq, kind, name, op, payload in sorted(log):
        if op == state.RESET:
            live = {key: row for key, row in live.items() if key[0] != kind}
        elif op == state.DELETED:
            live.pop((kind, name), None)
        else:
            live[kind, name] = (seq, kind, name, op, payload)
    return sorted(live.values(), key=repr)


LOG = "seq bigint, kind string, name string, op string, payload int"


@pytest.mark.parametrize("seed", range(4))
def test_latest_state_agrees_with_replay(spark, rows_of, seed):
    log = random_log(seed, 120)
    random.Random(seed).shuffle(log)
    frame = spark.createDataFrame(log, LOG)
    assert rows_of(state.latest_state(frame, ["name"])) == replay(log)


def test_resets_clear_their_scope_only(spark, rows_of):
    log = random_log(9, 300, ("job", "cluster", "pod"))
    frame = spark.createDataFrame(log, LOG)
    assert rows_of(state.latest_state(frame, ["kind", "name"], scope=["kind"])) == replay(log)


def test_log_without_resets_or_with_nothing(spark, rows_of):
    log = [(1, "job", "a", "CHANGED", 1), (2, "job", "a", "CHANGED", 2), (3, "job", "b", "DELETED", 0)]
    frame = spark.createDataFrame(log, LOG)
    assert rows_of(state.latest_state(frame, ["name"])) == [log[1]]
    assert state.latest_state(frame.where("seq < 0"), ["name"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_compacted_pieces_have_the_state_of_the_whole(spark, rows_of, seed):
    log = random_log(seed + 50, 200, ("job", "pod"))
    frame = spark.createDataFrame(log, LOG)
    pieces = [state.compacted(frame.where(f"seq % 4 = {i}"), ["kind", "name"], scope=["kind"]) for i in range(4)]
    joined = pieces[0].unionAll(pieces[1]).unionAll(pieces[2]).unionAll(pieces[3])
    assert rows_of(state.latest_state(joined, ["kind", "name"], scope=["kind"])) == replay(log)
    assert pieces[0].count() <= 20 + 2


def random_statuses(seed, n):
    source = random.Random(seed)
    rows, at = [], START
    for seq in range(n):
        at += timedelta(seconds=source.choice([0, 1, 100, 299, 300, 301, 4000, 90_000]))
        rows.append((seq, at, source.choice("aab"), source.choice(["Unknown", "Starting", "Started", "Stopping", "Stopped", None])))
    return rows


STATUS = "seq bigint, ts timestamp_ntz, key string, status string"


@pytest.mark.parametrize("block", ["hour", "day", "month", None])
def test_status_changes_agree_with_a_loop(spark, rows_of, block):
    rows = random_statuses(1, 300)
    expected, last = [], {}
    for seq, at, key, status in rows:
        seen = last.get(key)
        if seen is None or seen[1] != status or at - seen[0] > timedelta(seconds=300):
            expected.append((seq, at, key, status))
        last[key] = (at, status)
    frame = spark.createDataFrame(rows, STATUS).repartition(7)
    assert rows_of(state.status_changes(frame, "key", block=block)) == sorted(expected, key=repr)


@pytest.mark.parametrize("block", ["hour", "day", None])
def test_illegal_transitions_agree_with_a_loop(spark, rows_of, block):
    rows = random_statuses(2, 400)
    expected, last = [], {}
    for seq, at, key, status in rows:
        before, now = last.get(key), status or "Unknown"
        if before and before != now and now != "Unknown" and now not in state.JOB_TRANSITIONS[before]:
            expected.append((seq, at, key, status, before))
        last[key] = now
    frame = spark.createDataFrame(rows, STATUS)
    got = state.illegal_transitions(frame, "key", state.JOB_TRANSITIONS, state.JOB_FALLBACK, block=block)
    assert rows_of(got) == sorted(expected, key=repr)


def test_changes_watch_several_columns_and_keep_null_times(spark):
    rows = [(1, None, "a", "x"), (2, None, "a", "x"), (3, START, "a", "x"), (4, START, "a", "y")]
    frame = spark.createDataFrame(rows, STATUS).withColumn("revision", F.when(F.col("seq") == 2, 2).otherwise(1))
    got = state.status_changes(frame, "key", watched=("status", "revision"))
    assert sorted(r.seq for r in got.collect()) == [1, 2, 3, 4]
    assert sorted(r.seq for r in state.status_changes(frame, "key").collect()) == [1, 4]


def test_a_key_with_a_long_history_is_split_over_blocks(spark):
    """All rows are shuffled by key and block, once; only first and last rows of blocks are shuffled by key alone."""
    frame = spark.range(1000).select(
        F.col("id").alias("seq"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit("a").alias("key"), F.lit("s").alias("status")
    )
    changes = state.status_changes(frame, "key")
    changes.collect()
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "_first" in plan


@pytest.mark.parametrize("name", ["status_changes", "illegal_transitions", "illegal_cluster_transitions_drawn"])
def test_registered_histories_scan_and_shuffle_the_log_once(spark, name):
    from conftest import TESTDATA

    changes = QUERIES[name](spark, f"{TESTDATA}/sf0.001")
    changes.collect()
    final = changes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_scoped_resets_meet_one_row_per_key(spark, rows_of):
    rows = [(1, "a", "x", "CHANGED"), (2, "a", None, "RESET"), (3, "b", "x", "CHANGED"), (4, "a", "y", "CHANGED"), (5, "b", "y", "CHANGED"),
            (6, "b", "y", "DELETED"), (7, None, "x", "CHANGED")]
    frame = spark.createDataFrame(rows, "seq int, kind string, name string, op string")
    got = state.latest_state(frame, ["kind", "name"], scope=["kind"])
    assert rows_of(got.select("seq", "kind", "name")) == sorted([(3, "b", "x"), (4, "a", "y"), (7, None, "x")], key=repr)
    by_name = state.latest_state(frame, ["name"], scope=["kind"])
    assert sorted(r.seq for r in by_name.collect()) == [7]


def test_newest_per_name(spark, rows_of):
    rows = [("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, 1)]
    frame = spark.createDataFrame(rows, "name string, id int, uploaded int")
    assert rows_of(state.newest_per_name(frame, "name", "uploaded", "id")) == [("a", 3, 9), ("b", 4, 1)]
