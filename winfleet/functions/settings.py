"""Defaults for missing configuration and flags kept in annotation maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a missing setting reads as. The declared mode and policy default to upper-case words although the
# allowed words are spelled Manual/Automatic and Never/Always/OnlyIfFailed.
SPEC_DEFAULTS = {
    "savepoint_mode": "MANUAL",
    "savepoint_interval": 3600,
    "restart_policy": "NEVER",
    "restart_delay": 60,
    "restart_timeout": 180,
    "rescale_delay": 60,
    "rescale_policy": "JobParallelism",
}
STATUS_DEFAULTS = {
    "supervisor_status": "Unknown",
    "resource_status": "Unknown",
    "savepoint_mode": "Automatic",
    "restart_policy": "Always",
}

# Annotation names below the domain of the deployment.
REQUESTED_ACTION = "requested-action"
ACTION_TIMESTAMP = "action-timestamp"
WITHOUT_SAVEPOINT = "without-savepoint"
DELETE_RESOURCES = "delete-resources"
SHOULD_RESTART = "should-restart"


def or_default(value: Column, default: object) -> Column:
    """Null reads as the default; an empty text is kept."""
    return F.coalesce(value, F.lit(default))


def or_default_if_blank(value: Column, default: str | None) -> Column:
    """Null, empty and all-whitespace texts read as the default."""
    return F.when(value.rlike(r"\S"), value).otherwise(F.lit(default))


def annotation(annotations: Column, domain: str, name: str) -> Column:
    return F.element_at(annotations, F.lit(f"{domain}/{name}" if domain else name))


def requested_action(annotations: Column, domain: str = "") -> Column:
    return F.coalesce(F.upper(annotation(annotations, domain, REQUESTED_ACTION)), F.lit("NONE"))


def action_millis(annotations: Column, domain: str = "") -> Column:
    return F.coalesce(annotation(annotations, domain, ACTION_TIMESTAMP).cast("bigint"), F.lit(0))


def flag(annotations: Column, name: str, domain: str = "") -> Column:
    """True only for the word TRUE in any case."""
    return F.coalesce(F.upper(annotation(annotations, domain, name)) == "TRUE", F.lit(False))
