"""Session helpers: the settings the library relies on, and where jobs keep shared files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every entry point wants. Times are formatted and bucketed in UTC, so the session has to be in UTC too; AQE
# splits skewed joins and coalesces small shuffle partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_local_base: str | None = None


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. Underscores in keyword names stand for dots: ``spark_ui_enabled="false"``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Put a session made elsewhere into UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder the session was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for a job's files below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may run without that setting; it gets a folder of its own on this machine.
    """
    global _local_base
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="winfleet-")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
