"""Capacity, status and metric roll-ups. Every aggregation is decomposable, so hot groups shrink before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winfleet.functions.settings import or_default_if_blank
from winfleet.operators.joins import WITHIN, slots_and_jobs_by_prefix

# Supervisor statuses of jobs and clusters, the statuses in which a job occupies slots (as its cluster and as
# the job itself see it), those in which it is between two states, and those in which it rests.
STATUSES = ("Unknown", "Starting", "Started", "Stopping", "Stopped", "Terminated")
ACTIVE_FOR_CLUSTER = ("Stopping", "Starting", "Started")
ACTIVE_FOR_JOB = ("Starting", "Started")
TRANSITORY = ("Starting", "Stopping")
RESTING = ("Stopped", "Terminated")

# Limits that apply when a resource declares none.
DEFAULT_MIN, DEFAULT_MAX = 0, 32
DEFAULT_SLOTS = 1


def slots_needed(status: Column, parallelism: Column, active: tuple[str, ...] = ACTIVE_FOR_CLUSTER) -> Column:
    """Slots that one job needs: its parallelism while active, nothing otherwise."""
    return F.when(status.isin(*active), F.coalesce(parallelism, F.lit(0))).otherwise(F.lit(0))


def required_slots(
    jobs: DataFrame,
    clusters: DataFrame,
    status: str = "supervisor_status",
    parallelism: str = "parallelism",
    active: tuple[str, ...] = ACTIVE_FOR_CLUSTER,
    within: tuple[str, ...] = WITHIN,
) -> DataFrame:
    """Clusters with ``required_slots`` and ``n_jobs`` of the jobs whose names they prefix, 0 where there are none."""
    needed = slots_needed(F.col(status), F.col(parallelism), active)
    sums = slots_and_jobs_by_prefix(jobs, needed, within).withColumnRenamed("cluster_name", "name")
    return clusters.join(sums, ["name", *within], "left").na.fill(0, ["required_slots", "n_jobs"])


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Value between the limits, the upper one winning; missing limits read as 0 and 32."""
    floor = F.greatest(F.coalesce(value, F.lit(0)), F.coalesce(low, F.lit(DEFAULT_MIN)))
    return F.least(floor, F.coalesce(high, F.lit(DEFAULT_MAX)))


def workers_for(slots: Column, per_worker: Column, rounding: str = "half_up") -> Column:
    """Workers that hold the slots. The rule of the system rounds half up, so a small remainder gets no worker of its own;
    ``rounding="ceil"`` always covers the demand."""
    per = F.coalesce(per_worker, F.lit(DEFAULT_SLOTS))
    if rounding == "half_up":
        return F.floor((slots + F.floor(per / 2)) / per)
    if rounding == "ceil":
        return F.ceil(slots / per)
    raise ValueError(f"rounding must be 'half_up' or 'ceil', not {rounding!r}")


def required_workers(clusters: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Add ``declared_workers`` and ``required_workers``, both clamped, to the result of ``required_slots``.

    A cluster with policy None, or without jobs, requires what it declares.
    """
    low, high = F.col("min_task_managers"), F.col("max_task_managers")
    declared = clamp(F.col("task_managers"), low, high).cast("int")
    computed = clamp(workers_for(F.col("required_slots"), F.col("task_slots"), rounding), low, high).cast("int")
    policy = or_default_if_blank(F.col("rescale_policy"), "JobParallelism")
    fixed = (policy == "None") | (F.col("n_jobs") == 0)
    return clusters.withColumn("declared_workers", declared).withColumn(
        "required_workers", F.when(fixed, F.col("declared_workers")).otherwise(computed)
    )


def clamped_parallelism(parallelism: Column, low: Column, high: Column) -> Column:
    return clamp(parallelism, low, high)


def parallelism_changed(current: Column, declared: Column, low: Column, high: Column) -> Column:
    return clamp(current, low, high) != clamp(declared, low, high)


def pod_counts(
    pods: DataFrame, clusters: DataFrame, prefix: str = "taskmanager-", within: tuple[str, ...] = WITHIN
) -> DataFrame:
    """Clusters with ``replicas``, the number of pods named ``<prefix><cluster>-...`` in the same namespace."""
    named = pods.where(F.col("name").startswith(prefix)).select(
        F.substring("name", F.lit(len(prefix) + 1), F.length("name")).alias("name"), *within
    )
    counts = slots_and_jobs_by_prefix(named, F.lit(0), within).select(
        F.col("cluster_name").alias("name"), *within, F.col("n_jobs").alias("replicas")
    )
    return clusters.join(counts, ["name", *within], "left").na.fill(0, ["replicas"])


def total_capacity(clusters: DataFrame, replicas: str = "replicas", slots: str = "task_slots") -> DataFrame:
    """Add ``total_slots``: workers times slots, one slot where none is declared."""
    return clusters.withColumn("total_slots", F.col(replicas) * F.coalesce(F.col(slots), F.lit(DEFAULT_SLOTS)))


def rescale_plan(clusters: DataFrame, since_rescale: Column, delay: Column) -> DataFrame:
    """Add ``action`` and ``n`` from ``required_workers`` and ``replicas``.

    CREATE the missing workers at once; with too many, REMOVE_IDLE ones once the delay since the last rescale has passed and
    WAIT until then; otherwise NONE.
    """
    missing = F.col("required_workers") - F.col("replicas")
    action = (
        F.when(missing == 0, "NONE")
        .when(missing > 0, "CREATE")
        .when(since_rescale > delay, "REMOVE_IDLE")
        .otherwise("WAIT")
    )
    return clusters.withColumn("action", action).withColumn("n", F.abs(missing).cast("bigint"))


def status_counts(rows: DataFrame, status: str, domain: tuple[str, ...] = STATUSES, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per status, 0 for a status of the domain that does not occur; a missing or blank status counts as Unknown.

    With ``by``, the zeros are per group. One aggregation counts every status as a column, and the columns are then turned
    into rows, so a zero needs no join. Spellings outside the domain are summed under ``OTHER``, which appears only when it
    is not empty.
    """
    word = or_default_if_blank(F.col(status), "Unknown")
    counters = [F.count_if(word == value).alias(f"_{i}") for i, value in enumerate(domain)]
    other = F.count_if(~word.isin(*domain)).alias("_other")
    counts = rows.groupBy(*by).agg(*counters, other)
    entries = [F.struct(F.lit(value).alias("status"), F.col(f"_{i}").alias("n")) for i, value in enumerate(domain)]
    entries.append(F.struct(F.lit("OTHER").alias("status"), F.col("_other").alias("n")))
    turned = counts.select(*by, F.explode(F.array(*entries)).alias("_entry"))
    return turned.select(*by, "_entry.status", "_entry.n").where("status <> 'OTHER' OR n > 0")


@dataclass(frozen=True)
class Metric:
    """A column of a wide metric record: its name, the id in the long table, and its type."""

    column: str
    id: str
    type: str

    @property
    def default(self) -> Column:
        return F.lit("" if self.type == "string" else 0).cast(self.type)


# The metrics of a job and of a process (manager or worker).
JOB_METRICS = [
    Metric("total_number_of_checkpoints", "totalNumberOfCheckpoints", "int"),
    Metric("number_of_completed_checkpoints", "numberOfCompletedCheckpoints", "int"),
    Metric("number_of_in_progress_checkpoints", "numberOfInProgressCheckpoints", "int"),
    Metric("number_of_failed_checkpoints", "numberOfFailedCheckpoints", "int"),
    Metric("last_checkpoint_duration", "lastCheckpointDuration", "bigint"),
    Metric("last_checkpoint_size", "lastCheckpointSize", "bigint"),
    Metric("last_checkpoint_restore_timestamp", "lastCheckpointRestoreTimestamp", "bigint"),
    Metric("last_checkpoint_alignment_buffered", "lastCheckpointAlignmentBuffered", "bigint"),
    Metric("last_checkpoint_external_path", "lastCheckpointExternalPath", "string"),
    Metric("full_restarts", "fullRestarts", "int"),
    Metric("restarting_time", "restartingTime", "bigint"),
    Metric("uptime", "uptime", "bigint"),
    Metric("downtime", "downtime", "bigint"),
]
PROCESS_METRICS = [
    Metric("jvm_cpu_time", "Status.JVM.CPU.Time", "bigint"),
    Metric("jvm_cpu_load", "Status.JVM.CPU.Load", "double"),
    Metric("jvm_threads_count", "Status.JVM.Threads.Count", "int"),
    Metric("heap_max", "Status.JVM.Memory.Heap.Max", "bigint"),
    Metric("heap_used", "Status.JVM.Memory.Heap.Used", "bigint"),
    Metric("heap_committed", "Status.JVM.Memory.Heap.Committed", "bigint"),
    Metric("non_heap_max", "Status.JVM.Memory.NonHeap.Max", "bigint"),
    Metric("non_heap_used", "Status.JVM.Memory.NonHeap.Used", "bigint"),
    Metric("non_heap_committed", "Status.JVM.Memory.NonHeap.Committed", "bigint"),
    Metric("direct_count", "Status.JVM.Memory.Direct.Count", "int"),
    Metric("direct_memory_used", "Status.JVM.Memory.Direct.MemoryUsed", "bigint"),
    Metric("direct_total_capacity", "Status.JVM.Memory.Direct.TotalCapacity", "bigint"),
    Metric("mapped_count", "Status.JVM.Memory.Mapped.Count", "int"),
    Metric("mapped_memory_used", "Status.JVM.Memory.Mapped.MemoryUsed", "bigint"),
    Metric("mapped_total_capacity", "Status.JVM.Memory.Mapped.TotalCapacity", "bigint"),
    Metric("gc_copy_time", "Status.JVM.GarbageCollector.Copy.Time", "bigint"),
    Metric("gc_copy_count", "Status.JVM.GarbageCollector.Copy.Count", "int"),
    Metric("gc_mark_sweep_time", "Status.JVM.GarbageCollector.MarkSweepCompact.Time", "bigint"),
    Metric("gc_mark_sweep_count", "Status.JVM.GarbageCollector.MarkSweepCompact.Count", "int"),
    Metric("classes_loaded", "Status.JVM.ClassLoader.ClassesLoaded", "int"),
    Metric("classes_unloaded", "Status.JVM.ClassLoader.ClassesUnloaded", "int"),
    Metric("task_slots_total", "taskSlotsTotal", "int"),
    Metric("task_slots_available", "taskSlotsAvailable", "int"),
    Metric("num_registered_task_managers", "numRegisteredTaskManagers", "int"),
    Metric("num_running_jobs", "numRunningJobs", "int"),
]


def metrics_wide(
    rows: DataFrame, entity: list[str], metrics: list[Metric], id: str = "id", value: str = "value", seq: str = "seq"
) -> DataFrame:
    """One typed row per entity from the long form (entity, id, value, seq).

    The last value of a repeated id counts; an id that never occurs reads as 0 or ''; a value that is no number reads as
    null. A row updates one maximum, that of its entity and id, in a partial aggregation, so neither a hot entity nor the
    number of metrics matters; what is then turned into columns is one row per entity and id. Ids that no column asks for
    share one group, which keeps entities that have nothing else.
    """
    wanted = F.when(F.col(id).isin(*[metric.id for metric in metrics]), F.col(id))
    newest = rows.groupBy(*entity, wanted.alias("_id")).agg(F.max_by(F.struct(F.col(value).alias("v")), seq).alias("_last"))
    picked = []
    for metric in metrics:
        last = F.max(F.when(F.col("_id") == metric.id, F.col("_last")))
        picked.append(F.when(last.isNull(), metric.default).otherwise(last["v"].try_cast(metric.type)).alias(metric.column))
    return newest.groupBy(*entity).agg(*picked)


def group_readiness(jobs: DataFrame, group: list[str], finalizer: str) -> DataFrame:
    """Per group: ``all_ready`` (updated and not between two states), ``all_resting``, ``any_finalizer``."""
    status = F.coalesce(F.col("supervisor_status"), F.lit(""))
    ready = (F.coalesce(F.col("resource_status"), F.lit("")) == "Updated") & ~status.isin(*TRANSITORY)
    held = F.coalesce(F.array_contains("finalizers", finalizer), F.lit(False))
    return jobs.groupBy(*group).agg(
        F.bool_and(ready).alias("all_ready"),
        F.bool_and(status.isin(*RESTING)).alias("all_resting"),
        F.bool_or(held).alias("any_finalizer"),
    )


def readiness_of(clusters: DataFrame, readiness: DataFrame, key: list[str]) -> DataFrame:
    """Attach ``group_readiness`` to all clusters; for one without jobs "all" is true and "any" is false."""
    joined = clusters.join(readiness, key, "left")
    return joined.na.fill(True, ["all_ready", "all_resting"]).na.fill(False, ["any_finalizer"])


def has_enough_slots(total_slots: Column, needed: Column) -> Column:
    return total_slots >= needed
