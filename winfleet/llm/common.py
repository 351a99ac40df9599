"""What the operators share: tables in the shared folder, order of documents, raw files, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winfleet.session import shared_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder the session was started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage, survives lost executors, and gives the planner a size.

    Shuffle files of the write are dropped once it has ended, as nothing reads them again.
    """
    spark = frame.sparkSession
    importable(spark)
    path = shared_dir(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def digest(text: Column | str) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with about ``max_bytes`` of text each; a longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def new_file(folder: str, suffix: str) -> tuple[str, fs.FileSystem, str]:
    """A name that no other attempt of a task uses, with its file system and the path there. The folder is made.

    Only files that a finished task reports are read later, so those of failed attempts do no harm.
    """
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    name = f"part-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", filesystem, f"{path}/{name}"


def likely_in(keys: DataFrame, key: str, bits: int = 1 << 23) -> Callable[[str], Column]:
    """A test that holds for every value of ``keys`` and for few others, to thin out the large side before it is shuffled for a join.

    It is a bit map of ``bits`` bits whatever the number of keys, so its broadcast is bounded; with very many keys it fills up and
    lets everything pass, and the join that follows decides as before.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("value")).toPandas()
    held = np.zeros(bits // 64, dtype=np.int64)
    held[words["word"].to_numpy(dtype=np.int64)] = words["value"].to_numpy(dtype=np.int64)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy(dtype=np.int64)
        return pd.Series(((held[at >> 6] >> (at & 63)) & 1).astype(bool))

    return lambda column: test(F.pmod(F.xxhash64(column), F.lit(bits)))


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges (a, b), by alternating large and small stars.

    Every round takes minima per node (combined before the shuffle) and joins them back to the edges; hot nodes are left to
    skew-join splitting. Rounds end when the set of edges no longer changes; each is a table in the shared folder.
    Self-edges and repeated edges are allowed; a null end is ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = written(edges.distinct(), f"{name}-all")
    nodes = written(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{name}-nodes")
    edges = edges.where("u <> v")
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "m", "v")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, f"{name}-small")
        before, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
