import json

from pyspark.sql import functions as F

from winfleet.operators.documents import (
    annotation_flags,
    cluster_settings,
    declared_jobs,
    job_settings,
    operation_outcomes,
    parse_documents,
    savepoint_outcomes,
)


def bodies(spark, *documents):
    texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in documents]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string").orderBy("id")


JOB = {
    "restart": {"restartDelay": "15", "restartPolicy": "OnlyIfFailed"},
    "savepoint": {"savepointInterval": "7200"},
    "bootstrap": {"arguments": ["run", "--speed=9"]},
    "jobParallelism": 12,
}


def test_job_spec_with_quoted_numbers(spark):
    row = parse_documents(bodies(spark, JOB), "job_spec").first()
    assert not row.rejected
    assert row.resource.savepoint.savepointInterval == 7200
    assert row.resource.jobParallelism == 12 and row.resource.minJobParallelism is None
    assert row.resource.bootstrap.arguments == ["run", "--speed=9"]


def test_rejects_go_to_the_side_and_keep_their_text(spark):
    rows = parse_documents(bodies(spark, {"metadata": {"name": "a"}}, '{"metadata":{"name":"b"', "[1]", None), "job").collect()
    assert [r.rejected for r in rows] == [False, True, True, True]
    assert rows[0].resource.metadata.name == "a"
    assert rows[1].resource.metadata is None and rows[1].body == '{"metadata":{"name":"b"'


def test_text_is_parsed_once(spark):
    parsed = parse_documents(bodies(spark, JOB), "job_spec").where("NOT rejected").select("rejected", "resource.restart.*")
    assert parsed._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_unreadable_number_rejects_the_document(spark):
    documents = [{"jobParallelism": "many"}, {"restart": {"restartDelay": "soon"}}, {"restart": {"restartDelay": 5}}, {"restart": None}]
    rows = parse_documents(bodies(spark, *documents), "job_spec").orderBy("id").collect()
    assert [r.rejected for r in rows] == [True, True, False, False]
    assert rows[2].resource.restart.restartDelay == 5
    jobs = [{"spec": {"jobs": [{"name": "a", "spec": {"jobParallelism": p}}]}} for p in ("2", "x")]
    assert [r.rejected for r in parse_documents(bodies(spark, *jobs), "deployment").orderBy("id").collect()] == [False, True]


def test_last_duplicate_of_a_job_counts(spark):
    def job(name, parallelism):
        return {"name": name, "spec": {"jobParallelism": parallelism}}

    document = {"metadata": {"name": "d"}, "spec": {"jobs": [job("a", 1), job("b", 2), job("a", 3), job("c", 4), job("b", 5)]}}
    empty = {"metadata": {"name": "e"}, "spec": {"jobs": []}}
    parsed = parse_documents(bodies(spark, document, empty), "deployment")
    exploded = declared_jobs(parsed).select("pos", "job_name", F.col("job_spec.jobParallelism"))
    assert sorted(tuple(r) for r in exploded.collect()) == [(2, "a", 3), (3, "c", 4), (4, "b", 5)]
    assert "Exchange" not in declared_jobs(parsed.drop("id"))._jdf.queryExecution().optimizedPlan().toString()


def test_operation_outcomes(spark):
    done = {"status": {"id": "COMPLETED"}, "operation": {"location": "s3a://x"}}
    failed = {"status": {"id": "COMPLETED"}, "operation": {"location": "s3a://x", "failure-cause": {"class": "E"}}}
    nowhere = {"status": {"id": "COMPLETED"}, "operation": {}}
    rows = operation_outcomes(
        bodies(spark, done, failed, nowhere, {"status": {"id": "COMPLETED"}}, {"status": {"id": "IN_PROGRESS"}},
               {"status": {"id": "?"}}, {"status": {}}, "{", None)
    ).collect()
    assert [(r.outcome, r.location) for r in rows] == [
        ("done", "s3a://x"), ("error", None), ("error", None), ("error", None), ("pending", None),
        ("pending", None), ("pending", None), ("error", None), ("error", None),
    ]


def test_savepoint_outcomes(spark):
    cases = [("IN_PROGRESS", None), ("FAILED", None), ("COMPLETED", "p"), ("COMPLETED", None), ("OTHER", "p"), (None, None)]
    rows = savepoint_outcomes(spark.createDataFrame(cases, "status string, location string")).collect()
    assert [r.outcome for r in rows] == ["pending", "error", "done", "error", "error", "error"]


def test_defaults(spark):
    parsed = parse_documents(bodies(spark, {"spec": {}, "status": {"supervisorStatus": " ", "savepointPath": ""}}, {}), "job")
    names = ["savepoint_mode", "savepoint_interval", "restart_policy", "restart_delay", "restart_timeout", "supervisor_status",
             "resource_status", "status_savepoint_mode", "status_restart_policy", "current_savepoint_path", "current_parallelism"]
    for row in job_settings(parsed).select(*names).collect():
        assert tuple(row) == ("MANUAL", 3600, "NEVER", 60, 180, "Unknown", "Unknown", "Automatic", "Always", None, 0)


def test_declared_settings_win(spark):
    document = {"spec": {"savepoint": {"savepointPath": '"p"', "savepointTargetPath": " t "}, "restart": {"restartPolicy": ""}}}
    row = job_settings(parse_documents(bodies(spark, document), "job")).first()
    assert (row.savepoint_path, row.savepoint_target_path, row.restart_policy) == ("p", "t", "")


def test_cluster_defaults(spark):
    documents = [{"spec": {"supervisor": {"rescalePolicy": policy}}} for policy in ("None", " ", None)]
    rows = cluster_settings(parse_documents(bodies(spark, *documents), "cluster")).collect()
    assert [(r.rescale_policy, r.rescale_delay) for r in rows] == [("None", 60), ("JobParallelism", 60), ("JobParallelism", 60)]


def test_annotation_flags(spark):
    notes = {"o.org/requested-action": "trigger_savepoint", "o.org/without-savepoint": "true"}
    row = annotation_flags(parse_documents(bodies(spark, {"metadata": {"annotations": notes}}), "job"), domain="o.org").first()
    assert (row.requested_action, row.without_savepoint, row.delete_resources) == ("TRIGGER_SAVEPOINT", True, False)
