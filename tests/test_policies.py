"""Missing settings and statuses read as their defaults."""

from pyspark.sql import functions as F

from winfleet.operators import state, timing


def test_missing_and_blank_policies_restart(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "Never"), (4, "Always"), (5, "OnlyIfFailed")], "id int, policy string")
    for status, wanted in (("FAILED", [1, 2, 4, 5]), (None, [1, 2, 4]), ("FINISHED", [1, 2, 4])):
        got = rows.where(timing.should_restart(F.col("policy"), F.lit(status).cast("string"))).orderBy("id").collect()
        assert [r.id for r in got] == wanted


def test_missing_status_is_unknown_in_the_audit(spark):
    rows = spark.sql("SELECT id AS seq, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, 1 AS k, element_at(array('Starting', NULL, 'Started'), id) AS status FROM VALUES (1), (2), (3) AS t(id)")
    got = state.illegal_transitions(rows, "k", state.JOB_TRANSITIONS).orderBy("seq").collect()
    assert ("Unknown", "Started") in [(r.previous_status, r.status) for r in got]
