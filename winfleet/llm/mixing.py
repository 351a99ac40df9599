"""Mixing sources to target weights by entropy balancing.

Documents get rates that stay as close as possible, in relative entropy, to one copy of each, under the constraint that each source
supplies its target of words and no rate exceeds a cap. By the convex dual, a document's rate is then exp(multiplier * size), up to
the cap, with one multiplier per source: a source that must give more takes its long documents more often, one that must give less
takes fewer of them. Newton steps solve for the multipliers; their gradients and curvatures are sums over all documents, which
Spark forms from the number of documents of each source and size. Rates are then rounded into copies: inside groups of bounded
size, longest documents first, an extra copy is taken whenever the running total falls behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winfleet.llm.common import written
from winfleet.llm.packing import word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def target_words(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target from source, source_size.

    Weights repeat over the sources by code point, null last. The targets share the sum of all sizes by weight; what goes over
    ``cap`` times a source's size is shared again among the others until nothing does. Only sums come to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))  # one row per source
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).drop("rank"), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:  # the level of words per unit of weight only rises; it stops when no further source is full
        full = F.col("weight") * level >= F.col("most")
        taken, rest = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        before = level
        level = max(level, (total - (taken or 0.0)) / rest) if rest else level
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, "most").alias("target"))


def tilts(targets: DataFrame, sizes: DataFrame, cap: float = CAP, tolerance: float = 1e-9, steps: int = 80) -> DataFrame:
    """source, source_size, target, tilt: the multipliers by which the rates of each source add up to its target.

    ``sizes`` holds source, size, n: n documents of a size. The dual's gradient is target - sum(n * size * rate), its curvature
    sum(n * size^2 * rate) over documents below the cap. Sizes count in units of the source's mean size, so tilts are of
    moderate size. A step that leaves the interval known to hold the solution, where the sum is too small and too large, halves it
    instead; what no step can reach, as a target of the cap for all, ends at the interval's edge. Sources without words or target
    get the tilt minus infinity (rate 0).
    """
    sizes = sizes.where("size > 0").select(F.col("source").alias("of"), "size", "n")
    means = sizes.groupBy("of").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"), F.min("size").alias("least"))
    state = targets.join(means, F.expr("source <=> of"), "left").drop("of")
    open_ = (F.col("target") > 0) & (F.col("source_size") > 0)
    # At exp(low * least size) = 1e-9 almost nothing is left; at exp(high * least size) = cap every document is at the cap.
    span = F.col("unit") / F.col("least")
    state = state.select(
        "source", "source_size", "target", "unit",
        F.when(open_, 0.0).otherwise(float("-inf")).alias("tilt"), (-span * 40.0).alias("low"), (span * (np.log(cap) + 1e-9)).alias("high"),
        (~open_).alias("done"),
    )
    state = written(state, "mix-tilts")
    for _ in range(steps):
        going = state.where("NOT done").select(F.col("source").alias("of_state"), "unit", "tilt")
        rates = sizes.join(going, F.expr("of <=> of_state")).withColumn("x", F.col("size") / F.col("unit")).withColumn("rate", F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(50.0))))
        mass = F.col("n") * F.col("size") * F.least("rate", F.lit(cap))
        sums = rates.groupBy("of").agg(F.sum(mass).alias("reached"), F.sum(F.when(F.col("rate") < cap, mass * F.col("x")).otherwise(0.0)).alias("curve"))
        joined = state.join(sums, F.expr("source <=> of"), "left").drop("of")
        short = F.col("target") - F.col("reached")
        low, high = F.when(short > 0, F.col("tilt")).otherwise(F.col("low")), F.when(short > 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + short / F.col("curve")
        following = F.when((F.col("curve") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(short) <= F.col("target") * tolerance) | (high - low <= 1e-12 * (F.abs(low) + F.abs(high)))
        halted = F.coalesce(done, F.lit(True))
        moved = joined.select("source", "source_size", "target", "unit", F.when(halted, F.col("tilt")).otherwise(following).alias("tilt"), F.when(halted, F.col("low")).otherwise(low).alias("low"), F.when(halted, F.col("high")).otherwise(high).alias("high"), halted.alias("done"))
        state = written(moved, "mix-tilts")
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "source_size", "target", (F.col("tilt") / F.coalesce("unit", F.lit(1.0))).alias("tilt"))


def rounded_copies(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of documents that are each one of their kind."""
    copies, more = rounded_together(sizes, rates, np.ones(len(sizes), dtype=np.int64))
    return copies + more


def rounded_together(sizes: np.ndarray, rates: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies of each document, for ``counts`` documents alike: their rate rounded down, and how many of them take one more.

    These are as many as bring the running total closest to what is due.
    """
    copies = np.floor(rates + 1e-9)
    rest = np.maximum(rates - copies, 0.0)
    rest[rest <= 1e-9] = 0.0
    due = np.cumsum(rest * sizes * counts).tolist()
    more = np.zeros(len(sizes), dtype=np.int64)
    taken = 0.0
    for i, (size, share, n) in enumerate(zip(sizes.tolist(), rest.tolist(), counts.tolist())):
        if share and size:
            more[i] = min(n, max(0, int((due[i] - taken) / size + 0.5)))
            taken += more[i] * size
    return copies.astype(np.int64), more


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, group_rows: int = 4096) -> DataFrame:
    """doc_id, mark (hash of the text), source, size, source_size, target, tilt, rate, copies, taken for every row.

    A null text or one without words has size 0 and takes nothing; a null source is a source of its own. Rows that repeat are
    counted first and mixed together: their rate is rounded for all of them at once, and copies go to as many of them as needed.
    No copies go beyond ``cap``. Sources are dealt into groups of about ``group_rows`` different documents by a hash, so a hot
    one is rounded by many tasks; each group comes within half of its smaller documents of its share.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("mark"))
    rows = written(rows.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = written(rows.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("items")), "mix-histogram")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("items").alias("items"))
    state = tilts(target_words(sources.select("source", "source_size"), weights, cap), sizes.select("source", "size", "n"), cap)
    state = state.join(sources.select(F.col("source").alias("own"), "items"), F.expr("source <=> own")).drop("own")
    groups = F.greatest(F.lit(1), F.ceil(F.col("items") / group_rows))
    state = written(state.select(F.col("source").alias("own"), "source_size", "target", "tilt", groups.alias("groups")), "mix-rates")
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0))), F.lit(cap))).otherwise(0.0)
    dealt = rows.join(state, F.expr("source <=> own")).withColumn("rate", rate).withColumn("deal", F.pmod(F.xxhash64("doc_id", "mark"), "groups"))

    def round_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], ignore_index=True)
        group["copies"], group["more"] = rounded_together(group["size"].to_numpy(dtype=np.float64), group["rate"].to_numpy(), group["n"].to_numpy())
        return group[["doc_id", "mark", "source", "size", "source_size", "target", "tilt", "rate", "n", "copies", "more"]]

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, mark long, source string, size long, source_size long, target double, tilt double, rate double, n long, copies long, more long"
    names = ["doc_id", "mark", "source", "size", "source_size", "target", "tilt", "rate", "n", "deal"]
    rounded = dealt.select(names).groupBy("source", "deal").applyInPandas(round_group, schema)
    # One row again for each row; many alike are spelled out in bounded steps.
    step = 1000
    parts = rounded.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))))
    each = parts.withColumn("at", F.explode(F.sequence(F.col("part") * step, F.least(F.col("n"), (F.col("part") + 1) * step) - 1)))
    copies = (F.col("copies") + F.when(F.col("at") < F.col("more"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "mark", "source", "size", "source_size", "target", "tilt", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
