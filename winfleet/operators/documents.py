"""Nested JSON documents: parse, reject, explode, and read outcomes and settings. All of it is row-local: no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions import settings as S
from winfleet.schemas import DOCUMENTS, OPERATION_RESULT

_CORRUPT = "_corrupt_record"
# Parser options other than the default keep the optimizer from pruning the schema, so a bad field is always noticed.
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _textual(kind: T.DataType) -> T.DataType:
    """The type with every number read as text: documents may quote their numbers."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _textual(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_textual(kind.elementType))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return T.StringType()
    return kind


def _has_numbers(kind: T.DataType) -> bool:
    return _textual(kind) != kind


def _unreadable(value: Column, kind: T.DataType) -> Column:
    """Whether a number inside the value, read as text, is no number of its type."""
    if isinstance(kind, T.StructType):
        numeric = [f for f in kind.fields if _has_numbers(f.dataType)]
        return reduce(or_, [_unreadable(value[f.name], f.dataType) for f in numeric], F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda element: _unreadable(element, kind.elementType)), F.lit(False))
    return value.isNotNull() & value.try_cast(kind).isNull()


def _parsed(rows: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """Add ``_parsed``, the text read as the schema plus a field for text that does not fit.

    Exploding an array of one parsed document keeps the optimizer from copying the parse into every filter on its fields.
    """
    readable = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return rows.withColumn("_parsed", F.explode(F.array(F.from_json(body, readable, _OPTIONS))))


def parse_documents(rows: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Add ``resource`` (the typed document) and ``rejected`` (true for text that is not such a document).

    ``kind`` names an entry of ``schemas.DOCUMENTS``. Filter on ``rejected`` to split good rows from the side table; a
    rejected row keeps its text, and the fields of its resource are null. A document with a number that does not parse is
    rejected; numbers may be quoted. Only those top-level fields that a query uses are converted.
    """
    schema = DOCUMENTS[kind]
    parsed = _parsed(rows, body, _textual(schema))
    rejected = F.col("_parsed").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull() | _unreadable(F.col("_parsed"), schema)
    fields = []
    for field in schema.fields:
        value = F.col(f"_parsed.{field.name}")
        typed = value.try_cast(field.dataType) if _has_numbers(field.dataType) else value
        fields.append(F.when(~rejected, typed).alias(field.name))
    return parsed.withColumns({"rejected": rejected, "resource": F.struct(*fields)}).drop("_parsed")


def declared_jobs(deployments: DataFrame, jobs: str = "resource.spec.jobs") -> DataFrame:
    """One row per job that a deployment declares: ``pos, job_name, job_spec`` beside the deployment's columns.

    When a name occurs twice the last entry counts. That is decided inside the array, so documents need not be regrouped.
    """
    names = F.transform(F.col(jobs), lambda job: F.coalesce(job["name"], F.lit("")))
    backwards = F.reverse(F.col("_names"))

    def is_last(job: Column, pos: Column) -> Column:
        last = F.size("_names") - F.array_position(backwards, F.coalesce(job["name"], F.lit("")))
        return last == pos

    numbered = F.transform(F.col(jobs), lambda job, pos: F.struct(pos.alias("pos"), job["name"].alias("name"), job["spec"].alias("spec")))
    last_only = F.filter(numbered, lambda job: is_last(job, job["pos"]))
    return (
        deployments.withColumn("_names", names)
        .withColumn("_job", F.explode(last_only))
        .withColumns({"pos": F.col("_job.pos"), "job_name": F.col("_job.name"), "job_spec": F.col("_job.spec")})
        .drop("_names", "_job")
    )


def operation_outcomes(rows: DataFrame, body: str = "body") -> DataFrame:
    """Replace the JSON result of an asynchronous operation by ``outcome`` (done, pending, error) and ``location``.

    Anything but COMPLETED is still in progress; COMPLETED with a failure cause, or without a location, is an error; text
    that does not parse is an error.
    """
    result = _parsed(rows, body, OPERATION_RESULT)
    broken = F.col("_parsed.status").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull()
    location = F.col("_parsed.operation.location")
    outcome = (
        F.when(broken, "error")
        .when(~F.col("_parsed.status.id").eqNullSafe("COMPLETED"), "pending")
        .when(F.col("_parsed.operation.failure-cause").isNotNull() | location.isNull(), "error")
        .otherwise("done")
    )
    return (
        result.withColumn("outcome", outcome)
        .withColumn("location", F.when(F.col("outcome") == "done", location))
        .drop(body, "_parsed")
    )


def savepoint_outcomes(rows: DataFrame, status: str = "status", location: str = "location") -> DataFrame:
    """``outcome`` from an already extracted status word and location."""
    outcome = (
        F.when(F.col(status) == "IN_PROGRESS", "pending")
        .when((F.col(status) == "COMPLETED") & F.col(location).isNotNull(), "done")
        .otherwise("error")
    )
    return rows.withColumn("outcome", outcome)


def job_settings(jobs: DataFrame, spec: str = "resource.spec", status: str = "resource.status") -> DataFrame:
    """Settings of a job with every default filled in, beside the input columns."""
    declared, stored = S.SPEC_DEFAULTS, S.STATUS_DEFAULTS
    return jobs.withColumns(
        {
            "savepoint_mode": S.or_default(F.col(f"{spec}.savepoint.savepointMode"), declared["savepoint_mode"]),
            "savepoint_path": F.expr(f"""trim(BOTH '"' FROM {spec}.savepoint.savepointPath)"""),
            "savepoint_interval": S.or_default(
                F.col(f"{spec}.savepoint.savepointInterval"), declared["savepoint_interval"]
            ),
            "savepoint_target_path": F.trim(F.col(f"{spec}.savepoint.savepointTargetPath")),
            "restart_policy": S.or_default(F.col(f"{spec}.restart.restartPolicy"), declared["restart_policy"]),
            "restart_delay": S.or_default(F.col(f"{spec}.restart.restartDelay"), declared["restart_delay"]),
            "restart_timeout": S.or_default(F.col(f"{spec}.restart.restartTimeout"), declared["restart_timeout"]),
            "supervisor_status": S.or_default_if_blank(
                F.col(f"{status}.supervisorStatus"), stored["supervisor_status"]
            ),
            "resource_status": S.or_default_if_blank(F.col(f"{status}.resourceStatus"), stored["resource_status"]),
            "status_savepoint_mode": S.or_default_if_blank(
                F.col(f"{status}.savepointMode"), stored["savepoint_mode"]
            ),
            "status_restart_policy": S.or_default_if_blank(
                F.col(f"{status}.restartPolicy"), stored["restart_policy"]
            ),
            "current_savepoint_path": S.or_default_if_blank(F.col(f"{status}.savepointPath"), None),
            "current_parallelism": S.or_default(F.col(f"{status}.jobParallelism"), 0),
        }
    )


def cluster_settings(clusters: DataFrame, supervisor: str = "resource.spec.supervisor") -> DataFrame:
    """``rescale_delay`` and ``rescale_policy`` of a cluster with defaults filled in."""
    return clusters.withColumns(
        {
            "rescale_delay": S.or_default(F.col(f"{supervisor}.rescaleDelay"), S.SPEC_DEFAULTS["rescale_delay"]),
            "rescale_policy": S.or_default_if_blank(
                F.col(f"{supervisor}.rescalePolicy"), S.SPEC_DEFAULTS["rescale_policy"]
            ),
        }
    )


def annotation_flags(resources: DataFrame, annotations: str = "resource.metadata.annotations", domain: str = "") -> DataFrame:
    """Requested action, its time and the three flags of a resource, read from its annotation map."""
    notes = F.col(annotations)
    return resources.withColumns(
        {
            "requested_action": S.requested_action(notes, domain),
            "action_millis": S.action_millis(notes, domain),
            "without_savepoint": S.flag(notes, S.WITHOUT_SAVEPOINT, domain),
            "delete_resources": S.flag(notes, S.DELETE_RESOURCES, domain),
            "should_restart": S.flag(notes, S.SHOULD_RESTART, domain),
        }
    )
