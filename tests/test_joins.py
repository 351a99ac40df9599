import random

import pytest
from pyspark.sql import functions as F

from winfleet.operators import joins


def names(spark, values, **constants):
    frame = spark.createDataFrame([(v,) for v in values], "name string")
    return frame.withColumns({k: F.lit(v) for k, v in constants.items()})


def random_names(seed, n):
    source = random.Random(seed)
    return sorted({"-".join(source.choice(["a", "b", "", "ab"]) for _ in range(source.randint(1, 4))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(3))
def test_prefix_joins_agree_with_brute_force(spark, rows_of, seed):
    job_names, cluster_names = random_names(seed, 150), random_names(seed + 100, 40)
    jobs, clusters = names(spark, job_names), names(spark, cluster_names)
    pairs = [(j, c) for j in job_names for c in cluster_names if j.startswith(c + "-")]
    assert rows_of(joins.prefix_join(jobs, clusters, within=())) == sorted(pairs, key=repr)
    longest = {j: max((c for k, c in pairs if k == j), key=len) for j, _ in pairs}
    assert rows_of(joins.prefix_join(jobs, clusters, match="longest", within=())) == sorted(longest.items(), key=repr)
    alone = [(j,) for j in job_names if j not in longest]
    assert rows_of(joins.orphans(jobs, clusters, within=())) == sorted(alone, key=repr)
    listing = [(c, j[len(c) + 1:]) for j, c in pairs]
    assert rows_of(joins.job_listing(jobs, clusters, within=())) == sorted(listing, key=repr)


def test_prefix_join_stays_within_a_namespace(spark, rows_of):
    jobs = names(spark, ["c-j"], namespace="x").union(names(spark, ["c-j"], namespace="y"))
    clusters = names(spark, ["c"], namespace="x")
    joined = joins.prefix_join(jobs, clusters, within=("namespace",)).select("name", "namespace", "cluster_name")
    assert rows_of(joined) == [("c-j", "x", "c")]
    assert rows_of(joins.prefix_join(jobs, clusters, "longest", ("namespace",)).select("namespace", "cluster_name")) == [("x", "c")]
    assert rows_of(joins.orphans(jobs, clusters, within=("namespace",))) == [("c-j", "y")]


def test_prefix_join_is_an_equi_join(spark):
    joined = joins.prefix_join(names(spark, ["a-b"]), names(spark, ["a"]), within=())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_join_rejects_unknown_rule(spark):
    with pytest.raises(ValueError):
        joins.prefix_join(names(spark, ["a-b"]), names(spark, ["a"]), match="first")


def test_lookup_keeps_rows_without_partner(spark, rows_of):
    jobs = spark.createDataFrame([("c", "a"), ("c", "b")], "cluster string, job string")
    found = joins.lookup(jobs, names(spark, ["bootstrap-c-a"], image="i"), [F.lit("bootstrap-"), F.col("cluster"), F.lit("-"), F.col("job")], within=())
    assert rows_of(found) == [("c", "a", "bootstrap-c-a", "i"), ("c", "b", None, None)]


def test_lookup_stays_within_a_namespace(spark, rows_of):
    jobs = spark.createDataFrame([("x", "a"), ("y", "a")], "namespace string, job string")
    resources = names(spark, ["b-a"], namespace="x", image="i").union(names(spark, ["b-a"], namespace="y", image="k"))
    found = joins.lookup(jobs, resources, [F.lit("b-"), F.col("job")]).select("namespace", "resource_image")
    assert rows_of(found) == [("x", "i"), ("y", "k")]


def test_longest_prefix_sorts_no_rows_to_aggregate(spark):
    jobs, clusters = names(spark, ["a-b", "a-b-c"], namespace="n", size=1), names(spark, ["a", "a-b"], namespace="n")
    longest = joins.prefix_join(jobs, clusters, match="longest")
    assert "SortAggregate" not in longest._jdf.queryExecution().executedPlan().toString()


def test_names_of_many_dashes_give_few_rows(spark, rows_of):
    long = "-".join("abcdefghijklmnopqrstuvwxyz" * 4)
    jobs = spark.createDataFrame([(long, 1), ("a-b", 2), ("a-b", 3), ("x", 4), (None, 5), ("-", 6), ("a--b", 7)], "name string, size int")
    clusters = names(spark, ["a", "a-b-c", "zz", "", "a-"])
    exploded = joins.with_name_prefixes(jobs, "name", "prefix", clusters)
    assert exploded.where("size = 1").count() == 3  # as many dashes as names of clusters have: 0, 1 and 2
    wanted = [(n, s, c) for n, s in [(r.name, r.size) for r in jobs.collect()] for c in ["a", "a-b-c", "zz", "", "a-"] if n and n.startswith(f"{c}-")]
    joined = joins.prefix_join(jobs, clusters, within=())
    assert rows_of(joined.select("name", "size", "cluster_name")) == sorted(wanted, key=repr)
    generated = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in line]
    assert generated and not any("size#" in line for line in generated)


def test_resources_of_a_cluster(spark):
    everything = ["c", "c-a", "cc-a", "jobmanager-c", "jobmanager-c-1", "taskmanager-c-x", "bootstrap-c-a", "supervisor-c",
                  "supervisor-c-0", "taskmanager-cc-x"]
    frame = names(spark, everything, namespace="n")
    expected = {
        "cluster": ["c"], "job": ["c-a"], "service": ["jobmanager-c"], "bootstrap_job": ["bootstrap-c-a"],
        "jobmanager_pod": ["jobmanager-c-1"], "taskmanager_pod": ["taskmanager-c-x"], "supervisor_pod": ["supervisor-c-0"],
        "supervisor_deployment": ["supervisor-c"],
    }
    for kind, wanted in expected.items():
        assert [r.name for r in joins.resources_of(frame, kind, "n", "c").collect()] == wanted
        assert joins.resources_of(frame, kind, "other", "c").count() == 0
    together = joins.resources_by_kind(frame, tuple(expected), "n", "c").select("kind", "name")
    assert sorted(tuple(r) for r in together.collect()) == sorted((k, n) for k, ns in expected.items() for n in ns)
    twice = joins.resources_by_kind(names(spark, ["jobmanager-jobmanager-1"], namespace="n"), ("job", "jobmanager_pod"), "n", "jobmanager")
    assert sorted(r.kind for r in twice.collect()) == ["job", "jobmanager_pod"]


def test_unmanaged_running_jobs(spark, rows_of):
    running = spark.createDataFrame(
        [("1", "RUNNING"), ("2", "FAILED"), ("3", "CREATED"), ("4", "RUNNING"), ("5", "FINISHED"), ("6", "CANCELED")],
        "job_id string, job_status string",
    )
    managed = spark.createDataFrame([("4",), (None,)], "job_id string")
    assert rows_of(joins.unmanaged_running(running, managed)) == [("1", "RUNNING"), ("3", "CREATED")]


def test_empty_status_set_means_all(spark):
    jobs = spark.createDataFrame([("1", "RUNNING"), ("2", "FAILED")], "job_id string, job_status string")
    assert joins.with_status(jobs).count() == 2
    assert [r.job_id for r in joins.with_status(jobs, {"FAILED"}).collect()] == ["2"]


def test_idle_workers_and_their_hosts(spark, rows_of):
    path = "akka.tcp://flink@10.9.8.{}:6130/user/{}taskmanager_0"
    rows = [
        (1, path.format(1, ""), 4, 0), (2, path.format(2, "rpc/"), 4, 2), (3, path.format(3, ""), 4, 4),
        (4, path.format(4, "rpc/"), 4, 4), (5, "bad-path", 4, 4), (6, path.format(6, "") + "x", 4, 4), (7, None, 4, 4),
    ]
    workers = spark.createDataFrame(rows, "id int, path string, slots_number int, free_slots int")
    assert rows_of(joins.idle_workers(workers).select("id", "host_ip")) == [(3, "10.9.8.3"), (4, "10.9.8.4")]
    hosts = spark.createDataFrame(
        [(f"host-{i}", [(f"10.9.8.{i}",), (f"10.0.0.{i}",)]) for i in range(1, 8)] + [("none", None)],
        "name string, pod_ips array<struct<ip:string>>",
    )
    assert rows_of(joins.idle_hosts(workers, hosts)) == [("host-3",), ("host-4",)]
