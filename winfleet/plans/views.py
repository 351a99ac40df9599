"""Views that make sensor and fleet tables out of the test tables, in SQL that Spark and DuckDB read alike.

Each view is one table's rows with computed columns, so it adds no shuffle and column pruning reaches the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from winfleet.operators.rollups import JOB_METRICS, PROCESS_METRICS
from winfleet.session import use_utc


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str]
    where: str | None = None

    def sql(self) -> str:
        columns = ", ".join(f"{expression} AS {name}" for name, expression in self.columns.items())
        return f"SELECT {columns} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


def _name(k: str) -> str:
    """Names such as c10 and c10-3: prefixes of each other on purpose."""
    return (
        f"CASE WHEN {k} % 10 = 0 THEN 'c' || CAST({k} AS STRING) "
        f"ELSE 'c' || CAST({k} - {k} % 10 AS STRING) || '-' || CAST({k} % 10 AS STRING) END"
    )


# Two orders share a job name, in two namespaces; likewise suppliers share cluster names across namespaces.
_HALF = "CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT)"
_JOB_NAME = f"{_name(f'({_HALF} % 120)')} || '-j' || CAST({_HALF} AS STRING)"
_JOB_NAMESPACE = "'ns' || CAST(o_orderkey % 2 AS STRING)"
_SUPERVISOR_STATUS = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Started' WHEN '2-HIGH' THEN 'Starting' WHEN '3-MEDIUM' THEN 'Stopped' "
    "WHEN '4-NOT SPECIFIED' THEN 'Stopping' ELSE NULL END"
)


def _metric_view(number: str, ids: list[str]) -> View:
    """One metric per event; the last numbers name metrics that no record has."""
    cases = " ".join(f"WHEN {i} THEN '{id}'" for i, id in enumerate(ids))
    value = "CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(event_id % 100000 AS STRING) END"
    return View("events", {"entity": "user_id", "id": f"CASE {number} {cases} ELSE 'other' END", "value": value, "seq": "event_id"})


VIEWS = {
    "fleet_clusters": View(
        "supplier",
        {
            "uid": "s_suppkey",
            "namespace": "'ns' || CAST(CAST((s_suppkey - s_suppkey % 60) / 60 AS BIGINT) AS STRING)",
            "name": _name("(s_suppkey % 60)"),
            "supervisor_status": "CASE s_suppkey % 5 WHEN 0 THEN 'Started' WHEN 1 THEN 'Stopping' WHEN 2 THEN 'Stopped' "
            "WHEN 3 THEN ' ' ELSE NULL END",
            "healthy": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 4 = 1 END",
            "task_slots": "CAST(1 + s_suppkey % 4 AS INT)",
            "task_managers": "CAST(s_suppkey % 5 AS INT)",
            "min_task_managers": "CAST(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1 END AS INT)",
            "max_task_managers": "CAST(CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 16 END AS INT)",
            "rescale_policy": "CASE WHEN s_suppkey % 9 = 0 THEN 'None' WHEN s_suppkey % 9 = 1 THEN NULL "
            "ELSE 'JobParallelism' END",
            "rescale_ts": "CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END",
            "rescale_delay": "CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 50 + s_suppkey % 20 END AS INT)",
        },
    ),
    "fleet_jobs": View(
        "orders",
        {
            "uid": "o_orderkey",
            "namespace": _JOB_NAMESPACE,
            "name": _JOB_NAME,
            "supervisor_status": _SUPERVISOR_STATUS,
            "job_status": "CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END",
            "parallelism": "CAST(o_orderkey % 3 AS INT)",
            "status_ts": "o_orderdate",
            "resource_status": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 50 = 1 "
            "THEN 'Updating' ELSE 'Updated' END",
            "restart_policy": "CASE o_orderkey % 4 WHEN 0 THEN 'Always' WHEN 1 THEN 'OnlyIfFailed' WHEN 2 THEN 'Never' END",
            "held": "o_orderkey % 6 = 0",
        },
    ),
    "fleet_pods": View(
        "customer",
        {"uid": "c_custkey", "namespace": "'ns' || CAST(c_nationkey % 3 AS STRING)", "name": f"'taskmanager-' || {_name('(c_custkey % 120)')} || '-' || CAST(c_custkey AS STRING)"},
    ),
    "resources": View(
        "orders",
        {
            "uid": "o_orderkey",
            "namespace": "'ns' || CAST(o_custkey % 3 AS STRING)",
            "name": f"CASE o_orderpriority WHEN '1-URGENT' THEN 'taskmanager-' WHEN '2-HIGH' THEN 'jobmanager-' "
            f"WHEN '3-MEDIUM' THEN 'bootstrap-' ELSE '' END || {_JOB_NAME}",
        },
    ),
    "bootstraps": View(
        "orders",
        {
            "uid": "o_orderkey",
            "namespace": _JOB_NAMESPACE,
            "name": f"'bootstrap-' || {_JOB_NAME}",
            "created": "o_orderdate",
            "present": "o_orderstatus <> 'F'",
        },
    ),
    "cluster_jobs": View(
        "orders",
        {
            "job_id": "o_orderkey",
            "job_status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'FAILED' WHEN '2-HIGH' THEN 'FINISHED' "
            "WHEN '3-MEDIUM' THEN 'CANCELED' ELSE 'RUNNING' END",
        },
    ),
    "managed_jobs": View("orders", {"job_id": "o_orderkey", "present": "o_orderstatus = 'O'"}),
    "fleet_changes": View(
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "name": "'w' || CAST(user_id AS STRING)",
            "op": "CASE WHEN event_type = 'signup' AND user_id % 50 = 0 THEN 'RESET' WHEN event_type = 'error' THEN 'DELETED' "
            "ELSE 'CHANGED' END",
            "payload": "CAST(value AS DECIMAL(18,2))",
        },
    ),
    "status_log": View(
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "user_id": "user_id",
            "status": "CASE event_type WHEN 'signup' THEN 'Unknown' WHEN 'view' THEN 'Starting' WHEN 'click' THEN 'Started' "
            "WHEN 'purchase' THEN 'Stopping' ELSE 'Stopped' END",
        },
    ),
    "declared_specs": View(
        "part",
        {"id": "p_partkey", "bootstrap": "p_brand", "savepoint": "p_type", "restart": "p_size", "present": "p_partkey % 11 <> 0"},
    ),
    "deployed_specs": View(
        "part",
        {
            "id": "p_partkey",
            "bootstrap": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END",
            "savepoint": "CASE WHEN p_partkey % 7 = 0 THEN 'CHANGED' ELSE p_type END",
            "restart": "p_size",
            "present": "p_partkey % 13 <> 0",
        },
    ),
    "all_specs": View(
        "part",
        {
            "id": "p_partkey",
            "bootstrap": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END",
            "savepoint": "p_type",
            "restart": "p_size",
        },
    ),
    "op_results": View(
        "events",
        {
            "id": "event_id",
            "body": """CASE WHEN event_id % 4 = 0 THEN '{"status":{"id":"IN_PROGRESS"}}' """
            """WHEN event_id % 4 = 1 THEN '{"status":{"id":"COMPLETED"},"operation":{"failure-cause":{"class":"x"}}}' """
            """WHEN event_id % 4 = 2 THEN '{"status":{"id":"COMPLETED"},"operation":{"location":"s3a://b/' || """
            """CAST(event_id AS STRING) || '"}}' ELSE '{"status":{"id":"COMPLETED"},"operation":{}}' END""",
        },
    ),
    "workers": View(
        "supplier",
        {
            "id": "s_suppkey",
            "path": "CASE WHEN s_suppkey % 8 = 0 THEN 'bad-path' ELSE 'akka.tcp://flink@10.0.0.' || "
            "CAST(s_suppkey AS STRING) || ':41545/user/' || CASE WHEN s_suppkey % 2 = 0 THEN 'rpc/' ELSE '' END || "
            "'taskmanager_0' END",
            "slots_number": "CAST(4 AS INT)",
            "free_slots": "CAST(s_suppkey % 5 AS INT)",
        },
    ),
    "worker_hosts": View(
        "customer",
        {
            "name": f"'taskmanager-' || {_name('(c_custkey % 120)')} || '-' || CAST(c_custkey AS STRING)",
            "ip_a": "'10.0.0.' || CAST(c_custkey AS STRING)",
            "ip_b": "'10.1.0.' || CAST(c_custkey AS STRING)",
        },
    ),
    "metric_log": View(
        "events",
        {
            "entity": "user_id",
            "id": "event_type",
            "value": "CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END",
            "seq": "event_id",
        },
    ),
    "job_metric_log": _metric_view("event_id % 14", [metric.id for metric in JOB_METRICS]),
    "process_metric_log": _metric_view("event_id % 27", [metric.id for metric in PROCESS_METRICS]),
    "artifacts": View("documents", {"name": "source", "id": "doc_id", "uploaded": "n_chars"}),
    "deployment_documents": View(
        "orders",
        {
            "uid": "o_orderkey",
            "body": """CASE WHEN o_orderkey % 25 = 7 THEN '{"metadata":{"name":"d' || CAST(o_orderkey AS STRING) """
            """ELSE '{"metadata":{"name":"d' || CAST(o_orderkey AS STRING) || '","namespace":"ns"},"spec":{"cluster":"""
            """{"taskManagers":' || CAST(o_orderkey % 5 AS STRING) || ',"supervisor":{"rescalePolicy":"' || """
            """CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'None' END || '"}},"jobs":[' || """
            """'{"name":"a","spec":{"jobParallelism":' || CAST(o_custkey % 4 AS STRING) || '}},' || """
            """'{"name":"b","spec":{"jobParallelism":"' || CAST(o_custkey % 5 AS STRING) || """
            """'","restart":{"restartPolicy":"Always"}}},' || """
            """'{"name":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'c' END || """
            """'","spec":{"jobParallelism":' || CAST(o_custkey % 6 AS STRING) || '}}]}}' END""",
        },
    ),
    "job_documents": View(
        "orders",
        {
            "uid": "o_orderkey",
            "body": """'{"metadata":{"name":"j' || CAST(o_orderkey AS STRING) || '","annotations":{' || """
            """CASE WHEN o_orderkey % 3 = 0 THEN '"x.org/requested-action":"start","x.org/without-savepoint":"True",' """
            """WHEN o_orderkey % 3 = 1 THEN '"x.org/delete-resources":"yes","x.org/should-restart":"TRUE",' ELSE '' END || """
            """'"x.org/action-timestamp":"' || CAST(o_custkey AS STRING) || '"}},"spec":{"savepoint":{"savepointInterval":' """
            """|| CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN '"60"' ELSE CAST(o_custkey AS STRING) """
            """END || ',"savepointTargetPath":" s3a://b/' || CAST(o_orderkey AS STRING) || ' "},"restart":{' || """
            """CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '"restartPolicy":"Always","restartDelay":' || """
            """CAST(o_orderkey % 50 AS STRING) END || '}},"status":{"supervisorStatus":"' || """
            """CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'Started' END || '"}}'""",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view_of(rows: DataFrame, name: str) -> DataFrame:
    """Apply a view's columns to its table, which may be a stream."""
    view = VIEWS[name]
    filtered = rows.where(view.where) if view.where else rows
    return filtered.selectExpr(*[f"{expression} AS {column}" for column, expression in view.columns.items()])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view_of(table(spark, sf_dir, VIEWS[name].table), name)
