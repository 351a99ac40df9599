import pytest
from pyspark.sql import functions as F

from winfleet.operators import rollups

CLUSTER = (
    "name string, task_slots int, task_managers int, min_task_managers int, max_task_managers int, rescale_policy string"
)
JOB = "name string, supervisor_status string, parallelism int"


def test_workers_round_half_up(spark):
    cases = [(0, 1, 0), (2, 2, 1), (2, 1, 2), (5, 2, 3), (8, 2, 4), (1, 4, 0), (5, 4, 1), (6, 4, 2), (3, None, 3)]
    frame = spark.createDataFrame([c[:2] for c in cases], "need int, slots int")
    need, slots = F.col("need"), F.col("slots")
    assert [r[0] for r in frame.select(rollups.workers_for(need, slots)).collect()] == [c[2] for c in cases]
    assert [r[0] for r in frame.select(rollups.workers_for(need, slots, "ceil")).collect()] == [0, 1, 2, 3, 4, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        rollups.workers_for(need, slots, "floor")


def test_clamp_defaults_and_precedence(spark):
    cases = [(4, None, None, 4), (40, None, None, 32), (-1, None, None, 0), (None, None, None, 0), (5, 7, None, 7), (5, 7, 6, 6)]
    frame = spark.createDataFrame([c[:3] for c in cases], "v int, low int, high int")
    assert [r[0] for r in frame.select(rollups.clamp(F.col("v"), F.col("low"), F.col("high"))).collect()] == [c[3] for c in cases]
    changed = frame.select(rollups.parallelism_changed(F.lit(5), F.col("v"), F.col("low"), F.col("high"))).collect()
    assert [r[0] for r in changed] == [True, True, True, True, False, False]


def test_required_slots_and_workers(spark):
    clusters = spark.createDataFrame(
        [("c", 2, 3, None, None, None), ("c-d", 1, 1, None, None, " "), ("fixed", 1, 2, None, None, "None"),
         ("idle", 1, 40, None, None, "JobParallelism"), ("low", 4, 0, 1, 16, "JobParallelism")],
        CLUSTER,
    )
    jobs = spark.createDataFrame(
        [("c-a", "Started", 4), ("c-b", "Stopping", 1), ("c-x", "Stopped", 9), ("c-y", None, 9), ("c-z", "Starting", None),
         ("c-d-e", "Starting", 3), ("fixed-a", "Started", 7), ("low-a", "Started", 1), ("nobody", "Started", 5)],
        JOB,
    )
    sized = rollups.required_workers(rollups.required_slots(jobs, clusters, within=()))
    got = {r.name: (r.required_slots, r.n_jobs, r.declared_workers, r.required_workers) for r in sized.collect()}
    assert got == {"c": (8, 6, 3, 4), "c-d": (3, 1, 1, 3), "fixed": (7, 1, 2, 2), "idle": (0, 0, 32, 32), "low": (1, 1, 1, 1)}
    as_job = rollups.required_slots(jobs, clusters, active=rollups.ACTIVE_FOR_JOB, within=())
    assert {r.name: r.required_slots for r in as_job.collect()}["c"] == 7


def test_slots_are_summed_before_the_join(spark):
    clusters = spark.createDataFrame([("c", 1, 1, None, None, None)], CLUSTER)
    jobs = spark.createDataFrame([("c-a", "Started", 1)], JOB)
    plan = rollups.required_slots(jobs, clusters, within=())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("partial_sum(")


def test_rescale_plan(spark):
    frame = spark.createDataFrame(
        [("same", 2, 2, 100), ("grow", 5, 2, 0), ("shrink", 1, 4, 61), ("wait", 1, 4, 60)],
        "name string, required_workers int, replicas bigint, since bigint",
    )
    plan = rollups.rescale_plan(frame, F.col("since"), F.lit(60))
    assert [(r.action, r.n) for r in plan.collect()] == [("NONE", 0), ("CREATE", 3), ("REMOVE_IDLE", 3), ("WAIT", 3)]


def test_pods_and_capacity(spark):
    clusters = spark.createDataFrame([("c", 2, 0, None, None, None), ("e", None, 0, None, None, None)], CLUSTER)
    pods = spark.createDataFrame([("taskmanager-c-1",), ("taskmanager-c-2",), ("jobmanager-c-1",), ("taskmanager-cc-1",)], "name string")
    sized = rollups.total_capacity(rollups.pod_counts(pods, clusters, within=()))
    assert sorted((r.name, r.replicas, r.total_slots) for r in sized.collect()) == [("c", 2, 4), ("e", 0, 0)]
    assert spark.range(1).select(rollups.has_enough_slots(F.lit(4), F.lit(4))).first()[0]


def test_namespaces_do_not_mix(spark):
    clusters = spark.createDataFrame([("n1", "c"), ("n2", "c")], "namespace string, name string")
    pods = spark.createDataFrame([("n1", "taskmanager-c-1"), ("n1", "taskmanager-c-2"), ("n2", "taskmanager-c-1")], "namespace string, name string")
    assert sorted((r.namespace, r.replicas) for r in rollups.pod_counts(pods, clusters).collect()) == [("n1", 2), ("n2", 1)]
    jobs = spark.createDataFrame([("n1", "c-a", "Started", 4), ("n2", "c-a", "Started", 3)], f"namespace string, {JOB}")
    assert sorted((r.namespace, r.required_slots) for r in rollups.required_slots(jobs, clusters).collect()) == [("n1", 4), ("n2", 3)]


def test_status_counts_have_zeros(spark):
    frame = spark.createDataFrame([("Started",), ("Started",), (None,), (" ",), ("Odd",)], "s string")
    got = {r.status: r.n for r in rollups.status_counts(frame, "s").collect()}
    assert got == {"Unknown": 2, "Starting": 0, "Started": 2, "Stopping": 0, "Stopped": 0, "Terminated": 0, "OTHER": 1}
    empty = {r.status: r.n for r in rollups.status_counts(frame.where("false"), "s").collect()}
    assert empty == dict.fromkeys(rollups.STATUSES, 0)
    grouped = rollups.status_counts(frame.withColumn("ns", F.lit("x")), "s", by=("ns",))
    assert grouped.count() == 7


def test_job_metrics(spark):
    rows = [("e", "totalNumberOfCheckpoints", "9", 1), ("e", "totalNumberOfCheckpoints", "10", 2), ("e", "lastCheckpointSize", "100", 3)]
    frame = spark.createDataFrame(rows, "entity string, id string, value string, seq int")
    row = rollups.metrics_wide(frame, ["entity"], rollups.JOB_METRICS).first().asDict()
    others = {k: v for k, v in row.items() if k not in ("entity", "total_number_of_checkpoints", "last_checkpoint_size")}
    assert row["total_number_of_checkpoints"] == 10 and row["last_checkpoint_size"] == 100
    assert others.pop("last_checkpoint_external_path") == "" and set(others.values()) == {0} and len(others) == 10


def test_process_metrics(spark):
    rows = [(m.id, str(i), i) for i, m in enumerate(rollups.PROCESS_METRICS)] + [("unknown", "5", 99)]
    frame = spark.createDataFrame(rows, "id string, value string, seq int")
    row = rollups.metrics_wide(frame, [], rollups.PROCESS_METRICS).first()
    assert list(row) == list(range(25)) and isinstance(row.jvm_cpu_load, float)
    broken = spark.createDataFrame([("numRunningJobs", "many", 1)], "id string, value string, seq int")
    assert rollups.metrics_wide(broken, [], rollups.PROCESS_METRICS).first().num_running_jobs is None


def test_group_readiness(spark):
    rows = [
        ("ready", "Updated", "Started", []), ("ready", "Updated", None, None), ("moving", "Updated", "Stopping", ["f", "x"]),
        ("stale", None, "Stopped", ["f"]), ("rest", "Updated", "Stopped", []), ("rest", "Updated", "Terminated", []),
    ]
    jobs = spark.createDataFrame(rows, "name string, resource_status string, supervisor_status string, finalizers array<string>")
    readiness = rollups.group_readiness(jobs, ["name"], "x")
    clusters = spark.createDataFrame([(n,) for n in ("ready", "moving", "stale", "rest", "empty")], "name string")
    got = {r.name: (r.all_ready, r.all_resting, r.any_finalizer) for r in rollups.readiness_of(clusters, readiness, ["name"]).collect()}
    assert got == {
        "ready": (True, False, False), "moving": (False, False, True), "stale": (False, True, False),
        "rest": (True, True, False), "empty": (True, True, False),
    }
