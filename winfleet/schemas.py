"""Explicit schemas. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

# One sensor reading: eighteen digits and six decimals.
TEMPERATURE = T.DecimalType(24, 6)

SENSOR = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("location_id", T.StringType()),
        T.StructField("temperature", TEMPERATURE),
    ]
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
_INT = T.IntegerType()
_LONG = T.LongType()
_TEXTS = T.ArrayType(T.StringType())
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

METADATA = _struct(
    name=_TEXT,
    namespace=_TEXT,
    uid=_TEXT,
    resourceVersion=_TEXT,
    deletionTimestamp=_TEXT,
    finalizers=_TEXTS,
    annotations=_TEXT_MAP,
    labels=_TEXT_MAP,
)

BOOTSTRAP = _struct(
    pullSecrets=_TEXT,
    pullPolicy=_TEXT,
    image=_TEXT,
    className=_TEXT,
    jarPath=_TEXT,
    arguments=_TEXTS,
    serviceAccount=_TEXT,
)
SAVEPOINT = _struct(savepointMode=_TEXT, savepointPath=_TEXT, savepointInterval=_LONG, savepointTargetPath=_TEXT)
RESTART = _struct(restartPolicy=_TEXT, restartDelay=_LONG, restartTimeout=_LONG)

JOB_SPEC = _struct(
    bootstrap=BOOTSTRAP,
    savepoint=SAVEPOINT,
    restart=RESTART,
    jobParallelism=_INT,
    minJobParallelism=_INT,
    maxJobParallelism=_INT,
)
CLUSTER_SPEC = _struct(
    runtime=_struct(pullSecrets=_TEXT, pullPolicy=_TEXT, image=_TEXT),
    jobManager=_struct(serviceMode=_TEXT, serviceAccount=_TEXT, annotations=_TEXT_MAP, command=_TEXTS, args=_TEXTS),
    taskManager=_struct(taskSlots=_INT, serviceAccount=_TEXT, annotations=_TEXT_MAP, command=_TEXTS, args=_TEXTS),
    supervisor=_struct(
        pullSecrets=_TEXT,
        pullPolicy=_TEXT,
        image=_TEXT,
        serviceAccount=_TEXT,
        pollingInterval=_TEXT,
        taskTimeout=_INT,
        rescaleDelay=_INT,
        rescalePolicy=_TEXT,
        replicas=_INT,
    ),
    taskManagers=_INT,
    minTaskManagers=_INT,
    maxTaskManagers=_INT,
)
DEPLOYMENT_SPEC = _struct(cluster=CLUSTER_SPEC, jobs=T.ArrayType(_struct(name=_TEXT, spec=JOB_SPEC)))

JOB_DIGEST = _struct(bootstrap=_TEXT, savepoint=_TEXT, restart=_TEXT)
CLUSTER_DIGEST = _struct(runtime=_TEXT, jobManager=_TEXT, taskManager=_TEXT, supervisor=_TEXT)

JOB_STATUS = _struct(
    resourceStatus=_TEXT,
    supervisorStatus=_TEXT,
    clusterName=_TEXT,
    clusterHealth=_TEXT,
    jobParallelism=_INT,
    timestamp=_TEXT,
    jobId=_TEXT,
    jobStatus=_TEXT,
    savepointPath=_TEXT,
    savepointJobId=_TEXT,
    savepointTriggerId=_TEXT,
    savepointTimestamp=_TEXT,
    savepointRequestTimestamp=_TEXT,
    savepointMode=_TEXT,
    restartPolicy=_TEXT,
    digest=JOB_DIGEST,
)
CLUSTER_STATUS = _struct(
    resourceStatus=_TEXT,
    supervisorStatus=_TEXT,
    clusterHealth=_TEXT,
    taskManagers=_INT,
    taskSlots=_INT,
    taskManagerReplicas=_INT,
    totalTaskSlots=_INT,
    timestamp=_TEXT,
    rescaleTimestamp=_TEXT,
    serviceMode=_TEXT,
    digest=CLUSTER_DIGEST,
)
DEPLOYMENT_STATUS = _struct(
    resourceStatus=_TEXT,
    timestamp=_TEXT,
    digest=_struct(cluster=CLUSTER_DIGEST, jobs=T.ArrayType(_struct(name=_TEXT, job=JOB_DIGEST))),
)

# Resource documents by kind.
DOCUMENTS = {
    "deployment": _struct(metadata=METADATA, spec=DEPLOYMENT_SPEC, status=DEPLOYMENT_STATUS),
    "cluster": _struct(metadata=METADATA, spec=CLUSTER_SPEC, status=CLUSTER_STATUS),
    "job": _struct(metadata=METADATA, spec=JOB_SPEC, status=JOB_STATUS),
    "deployment_spec": DEPLOYMENT_SPEC,
    "cluster_spec": CLUSTER_SPEC,
    "job_spec": JOB_SPEC,
}

# Result of an asynchronous operation. The failure cause is kept as raw JSON text: only its presence matters.
OPERATION_RESULT = T.StructType(
    [
        T.StructField("status", _struct(id=_TEXT)),
        T.StructField(
            "operation",
            T.StructType([T.StructField("location", _TEXT), T.StructField("failure-cause", _TEXT)]),
        ),
    ]
)
