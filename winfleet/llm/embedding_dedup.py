"""Near-duplicate embeddings: all vectors against all by cosine, in tiles over principal axes.

Vectors that are exactly equal become one node with a count. The nodes of one length are turned onto the principal axes of their
second moments (a sum over all of them), cut into blocks along the first axis, and compared block by block. A tile adds up the
leading axes first; what the other axes can still add is at most the product of the two suffix norms, and pairs whose bound
falls below the threshold are given up. The pairs left are decided in double precision on the original components. A tile returns
link counts and a spanning forest of its links, never the pairs themselves, so a group of many alike vectors costs rows, not pairs.

Comparing all with all takes work that grows with the square of the vectors; each vector is sent to as many tiles as there are
blocks in reach along the first axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winfleet.llm.common import components, written

LEAD = 16
SUB = 1024
MARGIN = 1e-4  # more than the rounding of single-precision sums over unit vectors


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, group in batch.groupby("dim"):
            x = np.stack(group["vec"].to_numpy()).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, total in sums.items():
        rows, columns = np.triu_indices(dim)
        yield pd.DataFrame({"dim": dim, "i": rows, "j": columns, "total": total[rows, columns]})


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for every vector length: dim x dim numbers each, whatever the number of vectors."""
    sums = nodes.select("dim", "vec").mapInPandas(_moments, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    axes = {}
    for dim, group in sums.toPandas().groupby("dim"):
        moments = np.zeros((dim, dim))
        moments[group["i"], group["j"]] = moments[group["j"], group["i"]] = group["total"]
        axes[int(dim)] = np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into x, into y) whose cosine reaches the threshold; with ``same`` only those with the first index below."""
    x, y = _unit(x), _unit(y)
    turned_x, turned_y = x @ axes, y @ axes
    dim = x.shape[1]
    stops = sorted({min(LEAD, dim), min(2 * LEAD, dim), dim})
    rest = {k: (np.sqrt((turned_x[:, k:] ** 2).sum(axis=1)), np.sqrt((turned_y[:, k:] ** 2).sum(axis=1))) for k in stops}
    lead = stops[0]
    lead_x, lead_y = turned_x[:, :lead].astype(np.float32), turned_y[:, :lead].astype(np.float32)
    rest_x, rest_y = (r.astype(np.float32) for r in rest[lead])
    for i in range(0, len(x), SUB):
        for j in range(i if same else 0, len(y), SUB):
            bound = lead_x[i : i + SUB] @ lead_y[j : j + SUB].T
            bound += np.outer(rest_x[i : i + SUB], rest_y[j : j + SUB])
            possible = bound >= threshold - MARGIN
            left = int(np.count_nonzero(possible))
            if not left:
                continue
            if left > possible.size // 20:  # alike for the most part: one product is cheaper than gathering pairs
                a, b = np.nonzero(x[i : i + SUB] @ y[j : j + SUB].T >= threshold)
                a, b = a + i, b + j
            else:
                a, b = np.nonzero(possible)
                a, b = a + i, b + j
                total = (turned_x[a, :lead] * turned_y[b, :lead]).sum(axis=1)
                for low, high in zip(stops[:-1], stops[1:]):
                    total += (turned_x[a, low:high] * turned_y[b, low:high]).sum(axis=1)
                    on = total + rest[high][0][a] * rest[high][1][b] >= threshold - 1e-9
                    a, b, total = a[on], b[on], total[on]
                on = (x[a] * y[b]).sum(axis=1) >= threshold
                a, b = a[on], b[on]
            if same:
                on = a < b
                a, b = a[on], b[on]
            if len(a):
                yield a, b


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        same = group["left_block"].iloc[0] == group["right_block"].iloc[0]
        group = group.sort_values("node", ignore_index=True)
        on_left = (group["block"] == group["left_block"]).to_numpy()
        left = np.flatnonzero(on_left)
        right = left if same else np.flatnonzero(~on_left)
        copies = group["copies"].to_numpy()
        vectors = np.stack(group["vec"].to_numpy()).astype(np.float64)
        links = np.zeros(len(group), dtype=np.int64)
        root = np.arange(len(group))
        for a, b in linked_pairs(vectors[left], vectors[right], axes[vectors.shape[1]], threshold, same):
            a, b = left[a], right[b]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while True:  # smallest root on both ends of every link, until nothing changes
                low = np.minimum(root[a], root[b])
                before = root.copy()
                for end in (a, b):
                    np.minimum.at(root, root[end], low)
                    np.minimum.at(root, end, low)
                root = root[root]
                if (root == before).all():
                    break
        hit = np.flatnonzero(links)
        nodes = group["node"].to_numpy()
        return pd.DataFrame({"node": nodes[hit], "links": links[hit], "root": nodes[root[hit]]})

    return run


def near_vectors(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block_rows: int = 32768) -> DataFrame:
    """One row per vector: ``id_col``, n_links (other vectors with cosine >= threshold), component_id (smallest id reachable), kept.

    Vectors that are null, empty or all zero, or hold null, NaN or infinite components, link with nothing; so do vectors of
    different lengths. Rows with equal vectors link with each other, equal ids or not. A row without an id counts as a vector; a
    component of such rows alone has a null component_id, and they are not kept. An empty table gives an empty result.
    ``block_rows`` bounds the vectors of a block and so the memory of a tile; small tables are cut finer, for parallel work.
    """
    rows = frame.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(F.expr("size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)"), F.lit(False)))
    good = rows.where("ok")
    nodes = good.groupBy("vec").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("vec").alias("dim"), "vec", "copies", "first_id"), "vector-nodes")
    axes = _axes(nodes)

    @F.pandas_udf("double")
    def along(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        dims = vectors.map(len).to_numpy()
        for dim in set(dims):
            at = np.flatnonzero(dims == dim)
            out[at] = _unit(np.stack(vectors.to_numpy()[at]).astype(np.float64)) @ axes[int(dim)][:, 0]
        return pd.Series(out)

    # Ties along the axis are spread by a hash, so that they fill several blocks.
    placed = nodes.withColumn("first", along("vec")).withColumn("spot", F.col("first") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * 1e-12)
    placed = written(placed, "vector-places")
    counts = {r["dim"]: r["n"] for r in placed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = {dim: max(-(-n // block_rows), min(16, -(-n // 512))) for dim, n in counts.items()}
    most = max(wanted.values(), default=1)
    cuts = placed.groupBy("dim").agg(F.percentile_approx("spot", [k / most for k in range(1, most)] or [0.5], 10000).alias("cuts"))
    bounds = {r["dim"]: np.unique(np.array(r["cuts"])[np.round(np.linspace(0, most, wanted[r["dim"]] + 1)[1:-1]).astype(int) - 1]) for r in cuts.collect()}

    @F.pandas_udf("int")
    def block_of(dims: pd.Series, spots: pd.Series) -> pd.Series:
        out = np.zeros(len(dims), dtype=np.int32)
        for dim in set(dims):
            at = (dims == dim).to_numpy()
            out[at] = np.searchsorted(bounds[dim], spots.to_numpy()[at], side="right")
        return pd.Series(out)

    placed = placed.withColumn("block", block_of("dim", "spot"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    spans = placed.groupBy("dim", "block").agg(F.min("first").alias("low"), F.max("first").alias("high")).collect()
    pairs = [(int(a["dim"]), int(own), int(a["block"]), int(b["block"])) for a in spans for b in spans if a["dim"] == b["dim"] and a["block"] <= b["block"] and b["low"] - a["high"] <= reach for own in {a["block"], b["block"]}]
    pairs = frame.sparkSession.createDataFrame(pairs, "dim int, block int, left_block int, right_block int")
    tiles = placed.select("node", "dim", "vec", "copies", "block").join(pairs, ["dim", "block"])
    found = tiles.groupBy("dim", "left_block", "right_block").applyInPandas(_tile(axes, threshold), "node long, links long, root long")
    found = written(found, "vector-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-groups")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(links, "node", "left").join(groups, "node", "left").select("vec", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    smallest = per_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_node = written(per_node.join(smallest, "component").select("vec", "copies", "links", "component_id"), "vector-components")
    linked = good.join(per_node, "vec").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
