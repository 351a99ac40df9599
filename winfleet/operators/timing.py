"""Predicates on elapsed time. ``now`` is always an argument, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winfleet.functions.settings import STATUS_DEFAULTS, or_default_if_blank
from winfleet.functions.times import seconds_since

# Words of the restart policy, of a failed job, and of clusters that are not looked after.
ALWAYS, ONLY_IF_FAILED, FAILED = "Always", "OnlyIfFailed", "FAILED"
HALTED = ("Stopping", "Stopped")


def overdue(time: Column, now: Column, limit: Column) -> Column:
    """More than ``limit`` whole seconds have passed; a missing time is the epoch."""
    return seconds_since(time, now) > limit


def unhealthy(healthy: Column, time: Column, now: Column, limit: Column, status: Column) -> Column:
    """Not known to be healthy, and without an update for longer than the limit. A cluster that stops or is stopped never is."""
    halted = F.coalesce(status, F.lit("")).isin(*HALTED)
    return ~halted & ~F.coalesce(healthy, F.lit(False)) & overdue(time, now, limit)


def due(time: Column, now: Column, interval: Column) -> Column:
    """A periodic action is due: there is an interval and it has passed, its last second included."""
    return (interval > 0) & (seconds_since(time, now) >= interval)


def should_restart(policy: Column, job_status: Column) -> Column:
    """A policy that is missing or blank reads as Always."""
    policy = or_default_if_blank(policy, STATUS_DEFAULTS["restart_policy"])
    return (policy == ALWAYS) | ((policy == ONLY_IF_FAILED) & job_status.eqNullSafe(FAILED))


def restart_eligible(policy: Column, job_status: Column, time: Column, now: Column, delay: Column) -> Column:
    """The policy asks for a restart and the delay has passed."""
    return should_restart(policy, job_status) & overdue(time, now, delay)
