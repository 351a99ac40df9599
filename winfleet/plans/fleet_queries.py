"""Fleet-table queries over views of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winfleet.functions.digest import spec_digest
from winfleet.functions.times import seconds_since
from winfleet.operators import diff, documents, joins, rollups, state, timing
from winfleet.plans.registry import query, with_views
from winfleet.plans.views import table, view, view_of
from winfleet.session import shared_dir
from winfleet.sources.sensor import event_stream, table_stream
from winfleet.streaming.fleet import (
    read_latest_state,
    read_status_changes,
    start_latest_state,
    start_status_changes,
)
from winfleet.streaming.keyed import keyed_silences, keyed_status_changes, start_keyed

FINALIZER = "supervisor"

# ---- documents ----------------------------------------------------------------------------------------------------------


@query(
    "parsed_documents",
    with_views(
        "SELECT uid, NOT json_valid(body) AS rejected, CASE WHEN json_valid(body) THEN body ->> '$.metadata.name' END AS name, "
        "CASE WHEN json_valid(body) THEN CAST(body ->> '$.spec.cluster.taskManagers' AS INT) END AS task_managers, "
        "CASE WHEN json_valid(body) THEN CASE WHEN regexp_matches(body ->> '$.spec.cluster.supervisor.rescalePolicy', '\\S') "
        "THEN body ->> '$.spec.cluster.supervisor.rescalePolicy' ELSE 'JobParallelism' END END AS rescale_policy, "
        "CASE WHEN json_valid(body) THEN CAST(json_array_length(body, '$.spec.jobs') AS INT) END AS n_jobs "
        "FROM deployment_documents",
        "deployment_documents",
    ),
)
def _parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(view(spark, sf_dir, "deployment_documents"), "deployment")
    parsed = documents.cluster_settings(parsed, "resource.spec.cluster.supervisor")
    return parsed.select(
        "uid",
        "rejected",
        F.col("resource.metadata.name").alias("name"),
        F.col("resource.spec.cluster.taskManagers").alias("task_managers"),
        F.when(~F.col("rejected"), F.col("rescale_policy")).alias("rescale_policy"),
        F.size("resource.spec.jobs").alias("n_jobs"),
    )


@query(
    "rejected_documents",
    with_views("SELECT uid, body FROM deployment_documents WHERE NOT json_valid(body)", "deployment_documents"),
)
def _rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(view(spark, sf_dir, "deployment_documents"), "deployment")
    return parsed.where("rejected").select("uid", "body")


@query(
    "declared_jobs_exploded",
    with_views(
        "WITH numbered AS (SELECT uid, body, unnest(range(CAST(json_array_length(body, '$.spec.jobs') AS BIGINT))) AS pos "
        "FROM deployment_documents WHERE json_valid(body)), "
        "entries AS (SELECT uid, pos, json_extract(body, '$.spec.jobs[' || pos || ']') AS job FROM numbered), "
        "ranked AS (SELECT uid, pos, job, row_number() OVER (PARTITION BY uid, job ->> '$.name' ORDER BY pos DESC) AS r "
        "FROM entries) "
        "SELECT uid, CAST(pos AS INT) AS pos, job ->> '$.name' AS job_name, "
        "CAST(job ->> '$.spec.jobParallelism' AS INT) AS parallelism, job ->> '$.spec.restart.restartPolicy' AS restart_policy "
        "FROM ranked WHERE r = 1",
        "deployment_documents",
    ),
)
def _declared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(view(spark, sf_dir, "deployment_documents"), "deployment").where("NOT rejected")
    return documents.declared_jobs(parsed).select(
        "uid",
        "pos",
        "job_name",
        F.col("job_spec.jobParallelism").alias("parallelism"),
        F.col("job_spec.restart.restartPolicy").alias("restart_policy"),
    )


@query(
    "op_outcomes",
    with_views(
        "SELECT id, CASE WHEN body ->> '$.status.id' <> 'COMPLETED' THEN 'pending' "
        "WHEN json_extract(body, '$.operation.\"failure-cause\"') IS NOT NULL OR body ->> '$.operation.location' IS NULL "
        "THEN 'error' ELSE 'done' END AS outcome, "
        "CASE WHEN body ->> '$.status.id' = 'COMPLETED' THEN body ->> '$.operation.location' END AS location FROM op_results",
        "op_results",
    ),
)
def _op_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.operation_outcomes(view(spark, sf_dir, "op_results")).select("id", "outcome", "location")


@query(
    "config_defaults",
    with_views(
        "SELECT uid, 'MANUAL' AS savepoint_mode, coalesce(CAST(body ->> '$.spec.savepoint.savepointInterval' AS BIGINT), 3600) "
        "AS savepoint_interval, trim(body ->> '$.spec.savepoint.savepointTargetPath') AS savepoint_target_path, "
        "coalesce(body ->> '$.spec.restart.restartPolicy', 'NEVER') AS restart_policy, "
        "coalesce(CAST(body ->> '$.spec.restart.restartDelay' AS BIGINT), 60) AS restart_delay, "
        "coalesce(CAST(body ->> '$.spec.restart.restartTimeout' AS BIGINT), 180) AS restart_timeout, "
        "CASE WHEN regexp_matches(body ->> '$.status.supervisorStatus', '\\S') THEN body ->> '$.status.supervisorStatus' "
        "ELSE 'Unknown' END AS supervisor_status, 'Always' AS status_restart_policy FROM job_documents",
        "job_documents",
    ),
)
def _config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(view(spark, sf_dir, "job_documents"), "job")
    return documents.job_settings(parsed).select(
        "uid",
        "savepoint_mode",
        "savepoint_interval",
        "savepoint_target_path",
        "restart_policy",
        "restart_delay",
        "restart_timeout",
        "supervisor_status",
        "status_restart_policy",
    )


@query(
    "annotation_flags",
    with_views(
        "WITH notes AS (SELECT uid, json_extract(body, '$.metadata.annotations') AS a FROM job_documents) "
        "SELECT uid, coalesce(upper(a ->> '$.\"x.org/requested-action\"'), 'NONE') AS requested_action, "
        "CAST(a ->> '$.\"x.org/action-timestamp\"' AS BIGINT) AS action_millis, "
        "coalesce(upper(a ->> '$.\"x.org/without-savepoint\"') = 'TRUE', false) AS without_savepoint, "
        "coalesce(upper(a ->> '$.\"x.org/delete-resources\"') = 'TRUE', false) AS delete_resources, "
        "coalesce(upper(a ->> '$.\"x.org/should-restart\"') = 'TRUE', false) AS should_restart FROM notes",
        "job_documents",
    ),
)
def _annotation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(view(spark, sf_dir, "job_documents"), "job")
    return documents.annotation_flags(parsed, domain="x.org").select(
        "uid", "requested_action", "action_millis", "without_savepoint", "delete_resources", "should_restart"
    )


# ---- lookups, prefix joins, differences ---------------------------------------------------------------------------------


@query(
    "composed_key_lookup",
    with_views(
        "SELECT j.uid, j.namespace, j.name, b.created AS resource_created FROM fleet_jobs j LEFT JOIN bootstraps b "
        "ON b.present AND b.namespace = j.namespace AND b.name = 'bootstrap-' || j.name",
        "fleet_jobs",
        "bootstraps",
    ),
)
def _composed_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, bootstraps = view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "bootstraps").where("present")
    found = joins.lookup(jobs, bootstraps.select("namespace", "name", "created"), [F.lit("bootstrap-"), F.col("name")])
    return found.select("uid", "namespace", "name", "resource_created")


_KINDS = ("job", "bootstrap_job", "jobmanager_pod", "taskmanager_pod")


@query(
    "resource_filter",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, uid, name FROM resources WHERE namespace = 'ns1' AND starts_with(name, '{before}c10-')"
            for kind, before in zip(_KINDS, ("", "bootstrap-", "jobmanager-", "taskmanager-"))
        ),
        "resources",
    ),
)
def _resource_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.resources_by_kind(view(spark, sf_dir, "resources"), _KINDS, "ns1", "c10")
    return found.select("kind", "uid", "name")


_PAIRS = "FROM fleet_jobs j JOIN fleet_clusters c ON j.namespace = c.namespace AND starts_with(j.name, c.name || '-')"


@query("prefix_join_all", with_views(f"SELECT j.namespace, j.name, c.name AS cluster_name {_PAIRS}", "fleet_jobs", "fleet_clusters"))
def _prefix_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, clusters = view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters")
    pairs = joins.prefix_join(jobs.select("namespace", "name"), clusters.select("namespace", "name"))
    return pairs.select("namespace", "name", "cluster_name")


@query(
    "prefix_join_longest",
    with_views(
        f"SELECT j.namespace, j.name, j.uid, arg_max(c.name, length(c.name)) AS cluster_name {_PAIRS} GROUP BY ALL",
        "fleet_jobs",
        "fleet_clusters",
    ),
)
def _prefix_join_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, clusters = view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters")
    pairs = joins.prefix_join(jobs.select("namespace", "name", "uid"), clusters.select("namespace", "name"), match="longest")
    return pairs.select("namespace", "name", "uid", "cluster_name")


@query(
    "orphan_jobs",
    with_views(
        "SELECT uid, name FROM fleet_jobs j WHERE NOT EXISTS "
        "(SELECT 1 FROM fleet_clusters c WHERE c.namespace = j.namespace AND starts_with(j.name, c.name || '-'))",
        "fleet_jobs",
        "fleet_clusters",
    ),
)
def _orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, clusters = view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters")
    return joins.orphans(jobs, clusters).select("uid", "name")


@query(
    "cluster_job_listing",
    with_views(
        f"SELECT c.namespace, c.name AS cluster_name, substr(j.name, length(c.name) + 2) AS job_name {_PAIRS}",
        "fleet_jobs",
        "fleet_clusters",
    ),
)
def _cluster_job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.job_listing(view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters"))


@query(
    "unmanaged_running",
    with_views(
        "SELECT job_id, job_status FROM cluster_jobs WHERE job_status NOT IN ('FAILED', 'FINISHED', 'CANCELED') "
        "AND job_id NOT IN (SELECT job_id FROM managed_jobs WHERE present)",
        "cluster_jobs",
        "managed_jobs",
    ),
)
def _unmanaged_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    running, managed = view(spark, sf_dir, "cluster_jobs"), view(spark, sf_dir, "managed_jobs").where("present")
    return joins.unmanaged_running(running, managed).select("job_id", "job_status")


@query("jobs_by_status", with_views("SELECT uid, name FROM fleet_jobs WHERE job_status IN ('RUNNING')", "fleet_jobs"))
def _jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_status(view(spark, sf_dir, "fleet_jobs"), {"RUNNING"}).select("uid", "name")


_WORKER = "'^akka\\.tcp://flink@([0-9.]+):[0-9]+/user/(rpc/)?taskmanager_[0-9]+$'"
_IDLE = f"SELECT id, regexp_extract(path, {_WORKER}, 1) AS host_ip FROM workers WHERE free_slots = slots_number " \
    f"AND regexp_matches(path, {_WORKER})"


@query("idle_workers", with_views(_IDLE, "workers"))
def _idle_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.idle_workers(view(spark, sf_dir, "workers")).select("id", "host_ip")


@query(
    "idle_hosts",
    with_views(
        f"WITH idle AS ({_IDLE}) SELECT DISTINCT name FROM worker_hosts WHERE ip_a IN (SELECT host_ip FROM idle) "
        "OR ip_b IN (SELECT host_ip FROM idle)",
        "workers",
        "worker_hosts",
    ),
)
def _idle_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = view(spark, sf_dir, "worker_hosts")
    ips = F.array(F.struct(F.col("ip_a").alias("ip")), F.struct(F.col("ip_b").alias("ip")))
    return joins.idle_hosts(view(spark, sf_dir, "workers"), hosts.select("name", ips.alias("pod_ips")))


# ---- declared against deployed ------------------------------------------------------------------------------------------


@query(
    "spec_diff",
    with_views(
        "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'DELETE' WHEN b.id IS NULL THEN 'CREATE' "
        "WHEN a.bootstrap IS DISTINCT FROM b.bootstrap OR a.savepoint IS DISTINCT FROM b.savepoint "
        "OR a.restart IS DISTINCT FROM b.restart THEN 'UPDATE' ELSE 'NONE' END AS action "
        "FROM (SELECT * FROM declared_specs WHERE present) a FULL JOIN (SELECT * FROM deployed_specs WHERE present) b ON a.id = b.id",
        "declared_specs",
        "deployed_specs",
    ),
)
def _spec_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, deployed = (view(spark, sf_dir, name).where("present") for name in ("declared_specs", "deployed_specs"))
    return diff.spec_diff(declared, deployed, ["id"], ["bootstrap", "savepoint"], ["restart"])


@query(
    "spec_digest",
    with_views(
        "SELECT id, to_base64(unhex(md5('{' || concat_ws(',', CASE WHEN bootstrap IS NOT NULL THEN '\"bootstrap\":\"' || "
        "bootstrap || '\"' END, '\"savepoint\":\"' || savepoint || '\"', '\"restart\":' || restart) || '}'))) AS digest "
        "FROM all_specs",
        "all_specs",
    ),
)
def _spec_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.struct("bootstrap", "savepoint", "restart")
    return view(spark, sf_dir, "all_specs").select("id", spec_digest(spec).alias("digest"))


@query(
    "changed_components",
    with_views(
        "SELECT a.id, concat_ws(',', CASE WHEN b.id IS NULL OR a.bootstrap IS DISTINCT FROM b.bootstrap THEN 'JOB_MANAGER' END, "
        "CASE WHEN b.id IS NULL OR a.savepoint IS DISTINCT FROM b.savepoint THEN 'TASK_MANAGER' END, "
        "CASE WHEN b.id IS NULL OR a.restart IS DISTINCT FROM b.restart THEN 'RUNTIME' END) AS changes, "
        "b.id IS NULL OR a.bootstrap IS DISTINCT FROM b.bootstrap OR a.savepoint IS DISTINCT FROM b.savepoint "
        "OR a.restart IS DISTINCT FROM b.restart AS recreate FROM declared_specs a LEFT JOIN "
        "(SELECT * FROM deployed_specs WHERE present) b ON a.id = b.id",
        "declared_specs",
        "deployed_specs",
    ),
)
def _changed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dict(zip(diff.CLUSTER_COMPONENTS, ("bootstrap", "savepoint", "restart")))
    digests = {name: spec_digest(F.struct(c)) for name, c in parts.items()}
    deployed = view(spark, sf_dir, "deployed_specs").where("present")
    stored = deployed.select("id", *[digest.alias(f"stored_{name}") for name, digest in digests.items()])
    current = view(spark, sf_dir, "declared_specs").select("id", *[digest.alias(name) for name, digest in digests.items()])
    changes = diff.digest_changes({name: F.col(name) for name in parts}, {name: F.col(f"stored_{name}") for name in parts})
    changed = current.join(stored, "id", "left").select("id", changes.alias("names"))
    return changed.select("id", F.concat_ws(",", "names").alias("changes"), diff.must_recreate(F.col("names")).alias("recreate"))


# ---- latest state and changes -------------------------------------------------------------------------------------------

_LATEST = with_views(
    "WITH r AS (SELECT coalesce(max(seq), -1) AS s FROM fleet_changes WHERE op = 'RESET'), "
    "n AS (SELECT c.*, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM fleet_changes c, r "
    "WHERE c.op <> 'RESET' AND c.seq > r.s) SELECT seq, ts, name, op, payload FROM n WHERE rn = 1 AND op <> 'DELETED'",
    "fleet_changes",
)


@query("latest_state", _LATEST)
def _latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(view(spark, sf_dir, "fleet_changes"), ["name"])


@query("stream_latest_state", _LATEST)
def _stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    changes = view_of(table_stream(spark, sf_dir, "events", schema), "fleet_changes")
    path = shared_dir(spark, "latest-state")
    start_latest_state(changes, path, shared_dir(spark, "progress"), ["name"]).awaitTermination()
    return read_latest_state(spark, path, changes.schema, ["name"])


@query("stream_latest_state_batches", _LATEST)
def _stream_latest_state_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over several micro-batches, a file each, so that runs of the table are merged on the way."""
    events = table(spark, sf_dir, "events")
    folder, path = shared_dir(spark, "arrivals"), shared_dir(spark, "latest-state")
    events.repartitionByRange(6, "event_id").write.parquet(folder)
    changes = view_of(event_stream(spark, folder, events.schema, files_per_trigger=1), "fleet_changes")
    start_latest_state(changes, path, shared_dir(spark, "progress"), ["name"]).awaitTermination()
    return read_latest_state(spark, path, changes.schema, ["name"])


_CHANGES = with_views(
    "WITH p AS (SELECT *, lag(status) OVER w AS ps, lag(ts) OVER w AS pt FROM status_log "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) SELECT seq, ts, user_id, status FROM p "
    "WHERE (ps IS NULL OR ps <> status OR ts > pt + INTERVAL 300 SECOND)",
    "status_log",
)


@query("status_changes", _CHANGES)
def _status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.status_changes(view(spark, sf_dir, "status_log"), "user_id")


@query("stream_status_changes", _CHANGES)
def _stream_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    log = view_of(table_stream(spark, sf_dir, "events", schema), "status_log")
    path = shared_dir(spark, "status-changes")
    start_status_changes(log, path, shared_dir(spark, "progress"), "user_id").awaitTermination()
    return read_status_changes(spark, path, log.schema)


# Rows arrive up to 50 minutes late, in two runs; what the watermark has passed in the end is judged.
_PASSED = " AND epoch_us(ts) <= ((SELECT max(epoch_ms(ts)) FROM status_log) - 3600000) * 1000"


def _late_and_restarted(spark: SparkSession, sf_dir: str, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = table(spark, sf_dir, "events")
    folder, path, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "keyed"), shared_dir(spark, "progress")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(3_000_000_000))
    low, high = events.agg(F.min(arrival), F.max(arrival)).first()
    early = F.coalesce(arrival < F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    for arrived in (early, ~early):
        events.where(arrived).write.mode("append").parquet(folder)
        log = view_of(event_stream(spark, folder, events.schema), "status_log")
        start_keyed(keyed(log), path, checkpoint).awaitTermination()
    return spark.read.schema(log.schema).parquet(path)


@query("stream_status_changes_keyed", _CHANGES + _PASSED)
def _stream_status_changes_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late_and_restarted(spark, sf_dir, lambda log: keyed_status_changes(log, "user_id"))


_SILENCES = with_views(
    "WITH p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS nt FROM status_log) SELECT seq, ts, user_id, status FROM p "
    "WHERE (nt IS NULL OR nt > ts + INTERVAL 6 HOUR) AND epoch_us(ts + INTERVAL 6 HOUR) <= ((SELECT max(epoch_ms(ts)) FROM status_log) - 3600000) * 1000",
    "status_log",
)


@query("stream_overdue_alerts", _SILENCES)
def _stream_overdue_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign of each key before it was silent for six hours, raised by timers."""
    return _late_and_restarted(spark, sf_dir, lambda log: keyed_silences(log, "user_id", timedelta(hours=6)))


def _illegal_sql(pairs: str) -> str:
    values = ", ".join("('{}', '{}')".format(*pair.split(">")) for pair in pairs.split())
    return with_views(
        f"WITH p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, seq) AS ps FROM status_log), "
        f"allowed(a, b) AS (VALUES {values}) SELECT seq, ts, user_id, status, ps AS previous_status FROM p "
        f"WHERE ps <> status AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = ps AND b = status)",
        "status_log",
    )


def _illegal(name: str, allowed: dict[str, set[str]], always: set[str], pairs: str) -> None:
    @query(name, _illegal_sql(pairs))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return state.illegal_transitions(view(spark, sf_dir, "status_log"), "user_id", allowed, always)


# Fixed values, written out apart from the operator's own tables so that SQL and operator check each other.
_illegal(
    "illegal_transitions", state.JOB_TRANSITIONS, state.JOB_FALLBACK,
    "Unknown>Starting Unknown>Terminated Starting>Started Starting>Stopping Starting>Stopped Started>Stopping Started>Stopped "
    "Stopping>Stopped Stopping>Starting Stopping>Terminated Stopped>Stopping Stopped>Starting Stopped>Started "
    "Starting>Unknown Started>Unknown Stopping>Unknown Stopped>Unknown Terminated>Unknown",
)
_illegal(
    "illegal_transitions_drawn", state.JOB_TRANSITIONS_DRAWN, set(),
    "Unknown>Starting Unknown>Terminated Starting>Started Starting>Stopping Starting>Stopped Started>Stopping "
    "Stopping>Stopped Stopping>Starting Stopping>Terminated Stopped>Stopping Stopped>Starting Stopped>Started",
)
_illegal(
    "illegal_cluster_transitions", state.CLUSTER_TRANSITIONS, set(),
    "Unknown>Starting Unknown>Terminated Starting>Started Starting>Stopping Started>Stopping "
    "Stopping>Stopped Stopping>Starting Stopping>Terminated Stopped>Stopping",
)
_illegal(
    "illegal_cluster_transitions_drawn", state.CLUSTER_TRANSITIONS_DRAWN, set(),
    "Unknown>Starting Unknown>Terminated Starting>Started Starting>Stopping Started>Stopping "
    "Stopping>Stopped Stopping>Starting Stopping>Terminated Stopped>Starting Stopped>Stopping",
)


# ---- roll-ups -----------------------------------------------------------------------------------------------------------

_SLOTS = (
    "SELECT c.namespace, c.name, CAST(coalesce(sum(CASE WHEN j.supervisor_status IN ('Stopping', 'Starting', 'Started') "
    "THEN coalesce(j.parallelism, 0) ELSE 0 END), 0) AS BIGINT) AS required_slots, count(j.name) AS n_jobs "
    "FROM fleet_clusters c LEFT JOIN fleet_jobs j ON j.namespace = c.namespace AND starts_with(j.name, c.name || '-') "
    "GROUP BY c.namespace, c.name"
)


@query("required_slots", with_views(_SLOTS, "fleet_jobs", "fleet_clusters"))
def _required_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, clusters = view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters")
    return rollups.required_slots(jobs, clusters.select("namespace", "name")).select(
        "namespace", "name", "required_slots", "n_jobs"
    )


def _clamped(value: str) -> str:
    return f"CAST(least(greatest({value}, coalesce(min_task_managers, 0)), coalesce(max_task_managers, 32)) AS INT)"


def _workers_sql(computed: str) -> str:
    return (
        f"WITH slots AS ({_SLOTS}), workers_ AS (SELECT c.*, s.required_slots, s.n_jobs, {_clamped('task_managers')} AS "
        f"declared_workers, CASE WHEN rescale_policy = 'None' OR n_jobs = 0 THEN {_clamped('task_managers')} "
        f"ELSE {_clamped(computed)} END AS required_workers FROM fleet_clusters c JOIN slots s ON c.namespace = s.namespace AND c.name = s.name)"
    )


_HALF_UP = "(required_slots + task_slots // 2) // task_slots"
_CEIL = "(required_slots + task_slots - 1) // task_slots"


def _with_workers(spark: SparkSession, sf_dir: str, rounding: str = "half_up") -> DataFrame:
    slots = rollups.required_slots(view(spark, sf_dir, "fleet_jobs"), view(spark, sf_dir, "fleet_clusters"))
    return rollups.required_workers(slots, rounding)


def _workers_query(name: str, rounding: str, computed: str) -> None:
    sql = with_views(
        f"{_workers_sql(computed)} SELECT namespace, name, declared_workers, required_workers FROM workers_", "fleet_jobs", "fleet_clusters"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _with_workers(spark, sf_dir, rounding).select("namespace", "name", "declared_workers", "required_workers")


_workers_query("required_workers", "half_up", _HALF_UP)
_workers_query("required_workers_ceil", "ceil", _CEIL)

_REPLICAS = (
    "SELECT c.namespace, c.name, c.task_slots, count(p.name) AS replicas FROM fleet_clusters c LEFT JOIN fleet_pods p "
    "ON p.namespace = c.namespace AND starts_with(p.name, 'taskmanager-' || c.name || '-') GROUP BY ALL"
)


@query(
    "total_capacity",
    with_views(
        f"WITH r AS ({_REPLICAS}) SELECT namespace, name, replicas, replicas * coalesce(task_slots, 1) AS total_slots FROM r",
        "fleet_pods",
        "fleet_clusters",
    ),
)
def _total_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rollups.pod_counts(view(spark, sf_dir, "fleet_pods"), view(spark, sf_dir, "fleet_clusters"))
    return rollups.total_capacity(counted).select("namespace", "name", "replicas", "total_slots")


@query(
    "rescale_plan",
    with_views(
        f"{_workers_sql(_HALF_UP)}, r AS ({_REPLICAS}), e AS (SELECT w.*, r.replicas, "
        "(epoch_ms(TIMESTAMP '2024-01-01 00:01:00') - coalesce(epoch_ms(rescale_ts), 0)) // 1000 AS since "
        "FROM workers_ w JOIN r ON w.namespace = r.namespace AND w.name = r.name) SELECT namespace, name, required_workers, replicas, "
        "CASE WHEN required_workers = replicas THEN 'NONE' WHEN required_workers > replicas THEN 'CREATE' "
        "WHEN since > coalesce(rescale_delay, 60) THEN 'REMOVE_IDLE' ELSE 'WAIT' END AS action, "
        "CAST(abs(required_workers - replicas) AS BIGINT) AS n FROM e",
        "fleet_jobs",
        "fleet_clusters",
        "fleet_pods",
    ),
)
def _rescale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rollups.pod_counts(view(spark, sf_dir, "fleet_pods"), _with_workers(spark, sf_dir))
    since = seconds_since(F.col("rescale_ts"), F.lit("2024-01-01 00:01:00"))
    planned = rollups.rescale_plan(counted, since, F.coalesce("rescale_delay", F.lit(60)))
    return planned.select("namespace", "name", "required_workers", "replicas", "action", "n")


@query(
    "status_counts",
    with_views(
        "WITH d(status) AS (VALUES ('Unknown'), ('Starting'), ('Started'), ('Stopping'), ('Stopped'), ('Terminated')) "
        "SELECT d.status, count(j.uid) AS n FROM d LEFT JOIN fleet_jobs j ON coalesce(j.supervisor_status, 'Unknown') = d.status "
        "GROUP BY d.status",
        "fleet_jobs",
    ),
)
def _status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.status_counts(view(spark, sf_dir, "fleet_jobs"), "supervisor_status")


def _status_counts_within(name: str, rows: str) -> None:
    sql = with_views(
        "WITH d(status) AS (VALUES ('Unknown'), ('Starting'), ('Started'), ('Stopping'), ('Stopped'), ('Terminated')), "
        f"ns AS (SELECT DISTINCT namespace FROM {rows}) SELECT ns.namespace, d.status, count(j.uid) AS n FROM ns CROSS JOIN d "
        f"LEFT JOIN {rows} j ON j.namespace = ns.namespace AND coalesce(nullif(trim(j.supervisor_status), ''), 'Unknown') = d.status "
        "GROUP BY ns.namespace, d.status",
        rows,
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rollups.status_counts(view(spark, sf_dir, rows), "supervisor_status", by=("namespace",))


_status_counts_within("job_status_counts", "fleet_jobs")
_status_counts_within("cluster_status_counts", "fleet_clusters")


_METRICS = [
    rollups.Metric("views", "view", "double"),
    rollups.Metric("clicks", "click", "decimal(18,2)"),
    rollups.Metric("purchases", "purchase", "string"),
    rollups.Metric("errors", "error", "double"),
    rollups.Metric("signups", "signup", "decimal(18,2)"),
    rollups.Metric("refunds", "refund", "bigint"),
]


def _metric_sql(metric: rollups.Metric) -> str:
    kind = "VARCHAR" if metric.type == "string" else metric.type
    default = "''" if metric.type == "string" else "0"
    here = f"FILTER (WHERE id = '{metric.id}')"
    return (
        f"CASE WHEN count(*) {here} = 0 THEN CAST({default} AS {kind}) ELSE "
        f"TRY_CAST(arg_max(value, seq) {here} AS {kind}) END AS {metric.column}"
    )


@query(
    "metrics_wide",
    with_views(f"SELECT entity, {', '.join(_metric_sql(m) for m in _METRICS)} FROM metric_log GROUP BY entity", "metric_log"),
)
def _metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.metrics_wide(view(spark, sf_dir, "metric_log"), ["entity"], _METRICS)


def _record_query(name: str, view_name: str, metrics: list[rollups.Metric]) -> None:
    @query(name, with_views(f"SELECT entity, {', '.join(_metric_sql(m) for m in metrics)} FROM {view_name} GROUP BY entity", view_name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rollups.metrics_wide(view(spark, sf_dir, view_name), ["entity"], metrics)


_record_query("job_metrics", "job_metric_log", rollups.JOB_METRICS)
_record_query("process_metrics", "process_metric_log", rollups.PROCESS_METRICS)


@query(
    "group_readiness",
    with_views(
        "SELECT c.namespace, c.name, coalesce(bool_and(coalesce(resource_status, '') = 'Updated' AND "
        "coalesce(j.supervisor_status, '') NOT IN ('Starting', 'Stopping')) FILTER (WHERE j.uid IS NOT NULL), true) AS all_ready, "
        "coalesce(bool_and(coalesce(j.supervisor_status, '') IN ('Stopped', 'Terminated')) FILTER (WHERE j.uid IS NOT NULL), true) "
        "AS all_resting, coalesce(bool_or(held), false) AS any_finalizer FROM fleet_clusters c "
        "LEFT JOIN fleet_jobs j ON j.namespace = c.namespace AND starts_with(j.name, c.name || '-') GROUP BY c.namespace, c.name",
        "fleet_jobs",
        "fleet_clusters",
    ),
)
def _group_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "fleet_jobs").withColumn("finalizers", F.when(F.col("held"), F.array(F.lit(FINALIZER))))
    by_name = joins.with_name_prefixes(jobs, "name", "cluster_name")
    readiness = rollups.group_readiness(by_name, ["namespace", "cluster_name"], FINALIZER).withColumnRenamed("cluster_name", "name")
    return rollups.readiness_of(view(spark, sf_dir, "fleet_clusters").select("namespace", "name"), readiness, ["namespace", "name"])


@query(
    "newest_artifact",
    with_views(
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY uploaded DESC, id DESC) AS rn FROM artifacts) "
        "SELECT name, id, uploaded FROM n WHERE rn = 1",
        "artifacts",
    ),
)
def _newest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.newest_per_name(view(spark, sf_dir, "artifacts"), "name", "uploaded", "id")


# ---- elapsed time -------------------------------------------------------------------------------------------------------

_NOW = "1998-06-01 00:00:00"
_ELAPSED = f"(epoch_ms(TIMESTAMP '{_NOW}') - coalesce(epoch_ms(status_ts), 0)) // 1000"


@query("overdue_jobs", with_views(f"SELECT uid, {_ELAPSED} AS seconds FROM fleet_jobs WHERE {_ELAPSED} > 180", "fleet_jobs"))
def _overdue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW)
    late = view(spark, sf_dir, "fleet_jobs").where(timing.overdue(F.col("status_ts"), now, F.lit(180)))
    return late.select("uid", seconds_since(F.col("status_ts"), now).alias("seconds"))


@query(
    "unhealthy_clusters",
    with_views(
        "SELECT uid FROM fleet_clusters WHERE coalesce(supervisor_status, '') NOT IN ('Stopping', 'Stopped') "
        "AND NOT coalesce(healthy, false) "
        "AND (epoch_ms(TIMESTAMP '2024-01-01 00:05:00') - coalesce(epoch_ms(rescale_ts), 0)) // 1000 > 180 + uid % 200",
        "fleet_clusters",
    ),
)
def _unhealthy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = 180 + F.col("uid") % 200
    ill = timing.unhealthy(F.col("healthy"), F.col("rescale_ts"), F.lit("2024-01-01 00:05:00"), limit, F.col("supervisor_status"))
    return view(spark, sf_dir, "fleet_clusters").where(ill).select("uid")


_YEAR = 365 * 86_400


@query(
    "savepoint_due",
    with_views(
        f"SELECT uid FROM fleet_jobs WHERE parallelism > 0 AND {_ELAPSED} >= CAST(parallelism AS BIGINT) * {_YEAR}", "fleet_jobs"
    ),
)
def _savepoint_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    interval = F.col("parallelism").cast("bigint") * _YEAR
    return view(spark, sf_dir, "fleet_jobs").where(timing.due(F.col("status_ts"), F.lit(_NOW), interval)).select("uid")


@query(
    "restart_eligible",
    with_views(
        f"SELECT uid FROM fleet_jobs WHERE (coalesce(nullif(trim(restart_policy), ''), 'Always') = 'Always' OR (restart_policy = 'OnlyIfFailed' "
        f"AND job_status = 'FAILED')) AND {_ELAPSED} > 60",
        "fleet_jobs",
    ),
)
def _restart_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = timing.restart_eligible(
        F.col("restart_policy"), F.col("job_status"), F.col("status_ts"), F.lit(_NOW), F.lit(60)
    )
    return view(spark, sf_dir, "fleet_jobs").where(eligible).select("uid")
