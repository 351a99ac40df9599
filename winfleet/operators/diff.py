"""Declared against deployed: what to create, update and delete, and which components changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winfleet.functions.digest import spec_digest

# Components whose change is reported, in this order. A change of any cluster component means its resources
# are made anew.
CLUSTER_COMPONENTS = ("JOB_MANAGER", "TASK_MANAGER", "RUNTIME")
JOB_COMPONENTS = ("BOOTSTRAP",)


def spec_diff(
    declared: DataFrame, deployed: DataFrame, key: list[str], components: list[str], limits: list[str] | None = None
) -> DataFrame:
    """``key, action``: CREATE, DELETE, UPDATE or NONE for every key on either side.

    A row is updated when a component (value or struct) or a scale limit differs; nulls equal nulls. Both lists go into one
    digest per row, so only the key and 24 characters are shuffled, whatever the size of the specs. Keys are unique on each
    side.
    """
    limits = limits or []
    left = _fingerprint(declared, key, components, limits, "declared")
    right = _fingerprint(deployed, key, components, limits, "deployed")
    both = left.join(right, key, "full_outer")
    action = (
        F.when(F.col("declared").isNull(), "DELETE")
        .when(F.col("deployed").isNull(), "CREATE")
        .when(F.col("declared") != F.col("deployed"), "UPDATE")
        .otherwise("NONE")
    )
    return both.select(*key, action.alias("action"))


def _fingerprint(rows: DataFrame, key: list[str], components: list[str], limits: list[str], alias: str) -> DataFrame:
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate([*components, *limits])]
    spec = F.struct(*columns)
    return rows.select(*key, spec_digest(spec, rows.select(spec.alias("spec")).schema["spec"].dataType).alias(alias))


def component_changes(current: dict[str, Column], stored: dict[str, Column]) -> Column:
    """Names of the components whose stored digest differs from the digest of the current struct, in the given order.

    A missing stored digest counts as a change.
    """
    return digest_changes({name: spec_digest(spec) for name, spec in current.items()}, stored)


def digest_changes(current: dict[str, Column], stored: dict[str, Column]) -> Column:
    """The same from digests on both sides: made before a join, they spare it the specs."""
    changed = [F.when(~stored[name].eqNullSafe(digest), F.lit(name)) for name, digest in current.items()]
    return F.filter(F.array(*changed), lambda name: name.isNotNull())


def must_recreate(changes: Column) -> Column:
    """Whether a change of the cluster's components requires new resources."""
    return F.arrays_overlap(changes, F.array(*[F.lit(name) for name in CLUSTER_COMPONENTS]))


def digest_changed(stored: Column, spec: Column) -> Column:
    return stored.isNull() | (stored != spec_digest(spec))
