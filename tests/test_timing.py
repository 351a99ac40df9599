from pyspark.sql import functions as F

from winfleet.operators import timing


def test_time_predicates(spark):
    frame = spark.createDataFrame([("1970-01-01 00:01:00",), ("1970-01-01 00:00:59",), (None,)], "t string")
    time, now = F.col("t").cast("timestamp"), F.lit("1970-01-01 00:02:00").cast("timestamp")
    rows = frame.select(
        timing.overdue(time, now, F.lit(60)), timing.due(time, now, F.lit(60)), timing.due(time, now, F.lit(0)),
        timing.unhealthy(F.lit(False), time, now, F.lit(60), F.lit(None)), timing.unhealthy(F.lit(True), time, now, F.lit(60), F.lit("Started")),
        timing.unhealthy(F.lit(None).cast("boolean"), time, now, F.lit(60), F.lit("Started")),
        timing.unhealthy(F.lit(False), time, now, F.lit(60), F.lit("Stopping")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (False, True, False, False, False, False, False), (True, True, False, True, False, True, False),
        (True, True, False, True, False, True, False),
    ]


def test_restart_rules(spark):
    cases = [("Always", None, True), ("Always", "RUNNING", True), ("OnlyIfFailed", "FAILED", True), ("OnlyIfFailed", "RUNNING", False),
             ("OnlyIfFailed", None, False), ("Never", "FAILED", False), (None, "FAILED", True), ("", "RUNNING", True)]
    frame = spark.createDataFrame([c[:2] for c in cases], "policy string, status string")
    assert [r[0] for r in frame.select(timing.should_restart(F.col("policy"), F.col("status"))).collect()] == [c[2] for c in cases]
    now = F.lit("1970-01-01 00:01:00").cast("timestamp")
    for delay, expected in ((59, True), (60, False)):
        eligible = timing.restart_eligible(F.lit("Always"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"), now, F.lit(delay))
        assert spark.range(1).select(eligible).first()[0] is expected
