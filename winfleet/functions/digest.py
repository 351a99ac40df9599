"""Content digests of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def ordered_maps(value: Column, kind: T.DataType) -> Column:
    """The value with the entries of every map inside it in the order of their keys."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, T.StructType):
        fields = [ordered_maps(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda element: ordered_maps(element, kind.elementType))
    keys = F.array_sort(F.map_keys(value))
    return F.map_from_arrays(keys, F.transform(keys, lambda key: ordered_maps(value[key], kind.valueType)))


def spec_digest(spec: Column, kind: T.DataType | None = None) -> Column:
    """Base64 of the MD5 of the struct's JSON text, '' for a missing struct.

    Null fields are left out of the JSON and fields keep schema order, so equal specs have equal digests. Maps are equal in any
    order of their entries, so a spec that holds maps needs its type, ``kind``; without it they are written as they come.
    """
    if kind is not None:
        spec = ordered_maps(spec, kind)
    return F.coalesce(F.base64(F.unhex(F.md5(F.to_json(spec)))), F.lit(""))
