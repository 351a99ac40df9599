"""Lookups, name-prefix joins and set differences between resource tables.

No join here is hinted: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and AQE splits a skewed key otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses after which a job of the stream cluster no longer runs.
FINAL_STATUSES = ("FAILED", "FINISHED", "CANCELED")

# Fixed value: path of a worker, the host address being the first group. A path has to match as a whole.
WORKER_PATH = r"^akka\.tcp://flink@([0-9.]+):[0-9]+/user/(rpc/)?taskmanager_[0-9]+$"

# Name patterns of the resources that belong to a cluster, as (text before, text after, whole name).
RESOURCE_NAMES = {
    "cluster": ("", "", True),
    "job": ("", "-", False),
    "service": ("jobmanager-", "", True),
    "bootstrap_job": ("bootstrap-", "-", False),
    "jobmanager_pod": ("jobmanager-", "-", False),
    "taskmanager_pod": ("taskmanager-", "-", False),
    "supervisor_pod": ("supervisor-", "-", False),
    "supervisor_deployment": ("supervisor-", "", True),
}


#: Names are unique within a namespace only, so every operator here matches within one unless told otherwise.
WITHIN = ("namespace",)


def lookup(
    rows: DataFrame,
    resources: DataFrame,
    key: list[Column],
    name: str = "name",
    prefix: str = "resource_",
    within: tuple[str, ...] = WITHIN,
) -> DataFrame:
    """Left join on a composed name: the concatenation of ``key`` equals ``resources.name``, and the columns ``within`` are equal.
    Names are unique within these columns.

    The resource's columns come back with ``prefix`` before their names.
    """
    renamed = resources.select([F.col(c).alias(prefix + c) for c in resources.columns])
    keyed = rows.withColumn("_key", F.concat(*key))
    condition = F.col("_key") == F.col(prefix + name)
    for column in within:
        condition = condition & (keyed[column] == F.col(prefix + column))
    return keyed.join(renamed, condition, "left").drop("_key")


def belongs_to(kind: str, cluster: str, name: str = "name") -> Column:
    """Whether a resource name of the given kind belongs to the cluster."""
    before, after, whole = RESOURCE_NAMES[kind]
    wanted = before + cluster + after
    return F.col(name) == wanted if whole else F.col(name).startswith(wanted)


def resources_of(resources: DataFrame, kind: str, namespace: str, cluster: str) -> DataFrame:
    """Resources of one kind in a namespace that belong to one cluster. Both conditions reach the scan."""
    return resources.where((F.col("namespace") == namespace) & belongs_to(kind, cluster))


def resources_by_kind(resources: DataFrame, kinds: tuple[str, ...], namespace: str, cluster: str) -> DataFrame:
    """Resources of several kinds in one scan, with ``kind``; a name that fits two kinds gives two rows."""
    tests = {kind: belongs_to(kind, cluster) for kind in kinds}
    fits = reduce(lambda a, b: a | b, tests.values())
    matching = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()]))
    return resources.where((F.col("namespace") == namespace) & fits).withColumn("kind", F.explode(matching))


def _dashes(name: str) -> Column:
    return F.length(name) - F.length(F.replace(F.col(name), F.lit("-"), F.lit("")))


def with_name_prefixes(rows: DataFrame, name: str, alias: str, of: DataFrame | None = None, of_name: str = "name") -> DataFrame:
    """One row per proper prefix of the name that ends before a '-'.

    ``a-b-c`` gives ``a`` and ``a-b``: exactly the texts x for which the name starts with ``x-``. Equality with one of them
    replaces the startswith condition, which Spark could only run as a nested loop over all pairs. With ``of``, only prefixes
    with as many dashes as some name there come out: a name of many dashes then gives few rows. How many dashes names have is a
    short list, found before the rows are read.
    """
    numbered = rows.withColumn("_dashes", _dashes(name)).where("_dashes > 0")
    places = F.sequence(F.lit(1), "_dashes")
    if of is not None:
        wanted = of.select(F.collect_set(_dashes(of_name) + 1).alias("_wanted"))
        places = F.array_intersect(places, wanted.scalar())
    numbered = numbered.withColumn("_nth", F.explode(places))
    return numbered.withColumn(alias, F.expr(f"substring_index({name}, '-', _nth)")).drop("_dashes", "_nth")


def prefix_join(
    jobs: DataFrame, clusters: DataFrame, match: str = "all", within: tuple[str, ...] = WITHIN, key: str = "name"
) -> DataFrame:
    """Jobs with the clusters whose name they start with: job columns, then cluster columns as ``cluster_*``.

    Cluster names may contain '-', so a job can belong to several: ``match="all"`` keeps every pair, ``match="longest"``
    the one with the longest cluster name: the longest length is a hash aggregate over names alone, by which the name is
    then cut. ``within`` lists columns that must also be equal on both sides. Job names are unique (within those columns).
    """
    if match not in ("all", "longest"):
        raise ValueError(f"match must be 'all' or 'longest', not {match!r}")
    renamed = clusters.select([F.col(c).alias(f"cluster_{c}") for c in clusters.columns])
    # Names alone are exploded and matched; a job's other columns move once, for the names that have a cluster.
    prefixes = with_name_prefixes(jobs.select(key, *within), key, "_prefix", clusters, key)
    parents = clusters.select(F.col(key).alias("_prefix"), *within)
    owned = prefixes.join(parents, ["_prefix", *within], "left_semi")
    if match == "longest":
        longest = owned.groupBy(key, *within).agg(F.max(F.length("_prefix")).alias("_length"))
        named = jobs.join(longest, [key, *within]).withColumn("_prefix", F.substring(key, F.lit(1), F.col("_length"))).drop("_length")
        named = named.select(*jobs.columns, "_prefix")
    else:
        named = jobs.join(owned.distinct(), [key, *within]).select(*jobs.columns, "_prefix")
    condition = F.col("_prefix") == F.col(f"cluster_{key}")
    for column in within:
        condition = condition & (named[column] == F.col(f"cluster_{column}"))
    return named.join(renamed, condition).drop("_prefix")


def orphans(jobs: DataFrame, clusters: DataFrame, within: tuple[str, ...] = WITHIN, key: str = "name") -> DataFrame:
    """Jobs without any cluster whose name they start with. Job names are unique (within those columns)."""
    parents = clusters.select(F.col(key).alias("_prefix"), *within)
    exploded = with_name_prefixes(jobs.select(key, *within), key, "_prefix", clusters, key)
    owned = exploded.join(parents, ["_prefix", *within], "left_semi").select(key, *within)
    return jobs.join(owned, [key, *within], "left_anti")


def slots_and_jobs_by_prefix(jobs: DataFrame, required: Column, within: tuple[str, ...] = WITHIN) -> DataFrame:
    """``cluster_name, required_slots, n_jobs`` for every name that could be a cluster of some job.

    Summing before the join keeps a cluster with very many jobs from becoming a skewed join key: partial sums are built
    where the rows are.
    """
    exploded = with_name_prefixes(jobs.withColumn("_required", required), "name", "cluster_name")
    return exploded.groupBy("cluster_name", *within).agg(
        F.sum("_required").cast("bigint").alias("required_slots"), F.count("*").alias("n_jobs")
    )


def unmanaged_running(running: DataFrame, managed: DataFrame, key: str = "job_id", status: str = "job_status") -> DataFrame:
    """Jobs that run although no managed job carries their id: all, minus managed, minus finished."""
    alive = running.where(~F.col(status).isin(*FINAL_STATUSES))
    return alive.join(managed.select(key), key, "left_anti")


def with_status(jobs: DataFrame, statuses: set[str] | tuple[str, ...] = (), status: str = "job_status") -> DataFrame:
    """Jobs whose status is in the set; the empty set means all jobs."""
    return jobs.where(F.col(status).isin(*sorted(statuses))) if statuses else jobs


def job_listing(jobs: DataFrame, clusters: DataFrame, within: tuple[str, ...] = WITHIN) -> DataFrame:
    """``cluster_name, job_name``: every cluster's jobs with the cluster's name and the '-' cut off."""
    pairs = prefix_join(jobs.select("name", *within), clusters.select("name", *within), within=within)
    short = F.substring("name", F.length("cluster_name") + 2, F.length("name"))
    return pairs.select("cluster_name", *within, short.alias("job_name"))


def idle_workers(workers: DataFrame, pattern: str = WORKER_PATH) -> DataFrame:
    """Workers with all slots free whose path names a host, with ``host_ip``."""
    ip = F.regexp_extract("path", pattern, 1)
    return workers.where("free_slots = slots_number").withColumn("host_ip", ip).where("host_ip <> ''")


def idle_hosts(workers: DataFrame, hosts: DataFrame, pattern: str = WORKER_PATH) -> DataFrame:
    """Hosts (``name``, ``pod_ips`` an array of structs with ``ip``) on which an idle worker lives."""
    addresses = hosts.select("name", F.explode("pod_ips.ip").alias("host_ip"))
    idle = idle_workers(workers, pattern).select("host_ip")
    return addresses.join(idle, "host_ip", "left_semi").select("name").distinct()
