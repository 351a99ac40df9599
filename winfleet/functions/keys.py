"""UUID-shaped keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shape(hex32: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, start, length) for start, length in cuts])


def uuid_key(number: Column) -> Column:
    """The integer as the low 64 bits of a UUID whose high bits are zero."""
    return _shape(F.lpad(F.lower(F.hex(number.cast("bigint"))), 32, "0"))


def random_id() -> Column:
    """A fresh random id per row and run."""
    return F.uuid()


def repeatable_id(seed: Column) -> Column:
    """The same id for the same seed on every run, so that a recomputed task writes what the lost one wrote."""
    return _shape(F.md5(seed.cast("string")))
