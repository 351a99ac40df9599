"""Merkle dataset manifest: a content-addressed tree over all rows, with a proof for each row.

Rows are leaves. Within a source they are ranked by id, and every three consecutive nodes become one, level by level, until one
is left: the source's subroot. Subroots in order of their sources become the root in the same way. The store holds one record per
distinct inner node and height: its digest and its children; levels are tables, and a level's records are read once per descent.

Proofs come from the store alone. Requests descend from the root, one height at a time: at each node a leaf's rank has a digit that
selects a child, and the other children are a segment of its path. Requests that share their digits so far are still one request,
so a level of n nodes costs n/3 look-ups by digest, and no digest is hot. Segments are reversed for folding from leaf to root.

Column expressions only. Ranks come from one range-partitioned sort and the row counts of its partitions, so no source is sorted or
counted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winfleet.llm.common import written

FAN = 3
LAZY_HEIGHT = 2  # the last levels of a descent are not written: their rows carry whole paths


def encoded(column: Column) -> Column:
    """A value so that concatenated ones stay apart: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of a row's encoded values."""
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(children: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(children, lambda c: _hex(c["digest"])), "").cast("binary"), 256))


def ranked(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``rank`` (from 0, nulls first) within ``tree`` and ``size``, the tree's number of rows; written once.

    Rows alike in ``tree`` and ``order`` are spread by their place in the input and ranked in any order.
    """
    keys = [tree, *order, "__spread"]
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__spread").withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(F.col(tree).alias("__tree"), F.col("__part").alias("__of")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__tree")  # a row per partition that the tree reaches into
    parts = parts.select("__tree", "__of", (F.sum("__n").over(own.orderBy("__of")) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("size"))
    joined = placed.join(parts, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__of", "__tree", "__shift")


@dataclass
class Manifest:
    top: DataFrame  # the root's row: digest, height, carried; empty if there are no rows
    root: str | None  # its digest in hex
    height: int  # of the root; leaves have 0
    source_height: int  # no subroot is higher; all nodes over the subroots are
    store: dict[int, DataFrame]  # height -> digest, children (digest, height, carried)


def _raise(nodes: DataFrame, height: int, store: dict[int, DataFrame], name: str) -> tuple[DataFrame | None, int]:
    """Add levels above nodes (tree, size, rank, digest, height, carried) until each tree has one node; these, and the top height."""
    nodes = nodes.select("tree", "size", "rank", "digest", "height", "carried")
    tops, most = [nodes.where("size = 1")], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        height, most = height + 1, -(-most // FAN)
        child = F.struct("rank", "digest", "height", "carried")
        up = nodes.where("size > 1").groupBy("tree", "size", F.expr(f"rank div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        up = up.select("tree", F.ceil(F.col("size") / FAN).alias("size"), F.col("up").alias("rank"), _parent(F.col("children")).alias("digest"), F.lit(height).alias("height"), F.lit(None).cast(nodes.schema["carried"].dataType).alias("carried"), "children")
        up = written(up, f"{name}-{height}")
        record = F.first(F.transform("children", lambda c: F.struct(c["digest"].alias("digest"), c["height"].alias("height"), c["carried"].alias("carried")))).alias("children")
        store[height] = up.groupBy("digest").agg(record)
        nodes = up.drop("children")
        tops.append(nodes.where("size = 1"))
    return reduce(DataFrame.unionByName, tops), height


def manifest(leaves: DataFrame, source: str = "source", order: Sequence[str] = ("doc_id",), leaf: str = "leaf", carry: Sequence[str] = ()) -> Manifest:
    """Build the tree over ``leaves``; ``leaf`` is a hex digest of the whole row, and columns ``carry`` follow from it.

    A null source is a source of its own and comes first. Leaves of equal ``order`` stand in the order of their digests, so rows
    that repeat exactly change nothing by their order. A source with one row has its leaf as subroot; with one source, its subroot
    is the root; without rows there is none.
    """
    rows = leaves.select(F.col(source).alias("tree"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)], F.unhex(leaf).alias("digest"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    nodes = ranked(rows, "tree", [*[f"by{i}" for i in range(len(order))], "digest"], "merkle-leaves").withColumn("height", F.lit(0))
    store: dict[int, DataFrame] = {}
    subroots, source_height = _raise(nodes, 0, store, "merkle-source")
    over = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("by"), "digest", "height", "carried")
    tops, height = _raise(ranked(over, "tree", ["by"], "merkle-subroots"), source_height, store, "merkle-root")
    top = tops.select("digest", "height", "carried")
    root = top.select(_hex(F.col("digest")), "height").first()
    return Manifest(top, root[0] if root else None, root[1] if root else 0, source_height, store)


def _beside(children: Column, place: Column, left: bool) -> Column:
    """The children's digests left or right of ``place``, one after the other."""
    part = F.slice(children, 1, place) if left else F.slice(children, place + 2, FAN)
    return F.aggregate(part, F.lit(b""), lambda done, c: F.concat(done, c["digest"]))


def paths(built: Manifest) -> DataFrame:
    """A row for each leaf: leaf, subroot (hex), path, and what the leaves carry.

    ``path`` has a segment (left, right) per level from the leaf to the root: the digests of the other children, in order.
    """
    segment = "array<struct<left:binary,right:binary>>"
    subroot = F.when(F.col("height") <= built.source_height, F.col("digest"))
    front = built.top.select("digest", "height", "carried", F.array().cast(segment).alias("path"), subroot.alias("subroot"))
    for height in range(built.height, 0, -1):
        here, waiting = front.where(F.col("height") == height), front.where(F.col("height") < height)
        found = here.select("digest", "path", "subroot").join(built.store[height], "digest")
        found = found.select("path", "subroot", "children", F.posexplode("children").alias("place", "child"))
        step = F.struct(_beside(F.col("children"), F.col("place"), True).alias("left"), _beside(F.col("children"), F.col("place"), False).alias("right"))
        subroot = F.coalesce("subroot", F.when(F.col("child.height") <= built.source_height, F.col("child.digest")))
        found = found.select("child.digest", "child.height", "child.carried", F.concat("path", F.array(step)).cast(segment).alias("path"), subroot.alias("subroot"))
        front = waiting.unionByName(found)
        if height > LAZY_HEIGHT:
            front = written(front, f"merkle-front-{height}")
    carried = [c for c in built.top.schema["carried"].dataType.names if c != "_"]
    return front.select(_hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.reverse("path").alias("path"), *[f"carried.{c}" for c in carried])


def proof_digest(path: str) -> Column:
    """SHA-256 of a path's digests as hex text, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), "").cast("binary"), 256)


def folded(path: str, leaf: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(F.col(path), leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])).cast("binary"), 256))
