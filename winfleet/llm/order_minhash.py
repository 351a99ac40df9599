"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The words of a text give five-word shingles, each labelled with its occurrence. A sketch takes, for one hash function, the few
labelled shingles with the smallest hashes and keeps them in text order, so that it stays the same under small edits but not when
the text is rearranged. Texts that repeat shingles have further sketches over first occurrences only, and texts of few shingles
share one of their rarest shingles for certain. Documents that share a sketch or such a shingle are candidates; candidates form clusters. A cluster is compared in tiles
of a bounded number of documents: one matrix product gives the shingles in common of all pairs of a tile, and pairs that reach the
threshold are aligned in a band as wide as the threshold allows. Shingles count as common only where the alignment matches them.
Tiles hold a block of the cluster and its centre; only texts that are then still apart from the centre's class meet the other
blocks, so a large group of near copies is not compared pair by pair. Equal texts are one document in all of this.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winfleet.llm.common import components, digest, likely_in, text_slices, written
from winfleet.llm.words import mix, shingles, split_words

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 40
TAKEN = 6  # shingles per sketch; at similarity 0.8 texts of 40 shingles miss each other in all 40 sketches once in 60,000, long ones once in 200,000
FEW = 40  # below so many distinct shingles, candidates are found exactly
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))


def labelled(names: np.ndarray) -> np.ndarray:
    """Shingle names told apart by their occurrence."""
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(names) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
    out = names.copy()
    out[order[place > 0]] += mix(place[place > 0].astype(np.uint64))
    return out


def sketch(names: np.ndarray) -> np.ndarray:
    """SKETCHES numbers for the labelled shingles of one text, in text order."""
    taken = min(TAKEN, len(names))
    out = np.empty(SKETCHES, dtype=np.uint64)
    step = max(1, 200_000 // max(len(names), 1))
    for k in range(0, SKETCHES, step):
        ranked = (names[None, :] ^ _SEEDS[k : k + step, None]) * np.uint64(0x9E3779B97F4A7C15)
        ranked ^= ranked >> np.uint64(32)
        ranked *= np.uint64(0xD6E8FEB86659FD93)
        at = np.sort(np.argpartition(ranked, taken - 1, axis=1)[:, :taken], axis=1) if taken < len(names) else np.broadcast_to(np.arange(taken), (len(ranked), taken))
        total = np.zeros(len(ranked), dtype=np.uint64)
        for j in range(taken):
            total = total * np.uint64(0x100000001B3) + names[at[:, j]]
        out[k : k + step] = mix(total)
    return out


def aligned(left: np.ndarray, right: np.ndarray, threshold: float) -> float:
    """Similarity of two shingle sequences: distinct shingles that an alignment matches, of all distinct ones.

    The alignment is the longest common subsequence of labelled shingles inside a band: at the threshold, at most
    (n1 + n2) (1 - t) / (1 + t) shingles are unmatched, besides what the longer text has more.
    """
    n = len(left) + len(right)
    band = abs(len(left) - len(right)) + int(n * (1 - threshold) / (1 + threshold)) + 1
    a, b = labelled(left), labelled(right)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if np.any(np.diff(j) < 0):
        tails: list[int] = []
        ends: list[int] = []
        before = np.full(len(j), -1)
        for k, value in enumerate(j.tolist()):
            at = bisect_left(tails, value)
            before[k] = ends[at - 1] if at else -1
            if at == len(tails):
                tails.append(value)
                ends.append(k)
            else:
                tails[at], ends[at] = value, k
        chain = []
        k = ends[-1]
        while k >= 0:
            chain.append(k)
            k = before[k]
        i = i[chain]
    common = len(np.unique(left[i]))
    distinct = len(np.union1d(left, right))
    return common / distinct if distinct else 0.0


def similar_pairs(sets: list[np.ndarray], threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of names whose Jaccard similarity reaches the threshold; with ``split``, of one before and one from there.

    Only names that several sets hold can be common; they are the columns of a matrix, taken a few thousand at a time.
    """
    n = len(sets)
    cut = n if split is None else split
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    names, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column_of = np.cumsum(shared) - 1
    on = shared[columns]
    rows, columns = rows[on], column_of[columns[on]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    low = 0 if split is None else cut
    common = np.zeros((cut, n - low), dtype=np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(columns, [start, start + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        common += part[:cut] @ part[low:].T
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    i, j = np.nonzero(common >= threshold / (1 + threshold) * (sizes[:cut, None] + sizes[None, low:]) - 1e-6)
    j = j + low
    on = i < j
    return i[on], j[on]


def rare_keys(texts: DataFrame, threshold: float) -> DataFrame:
    """rep, place, sketch: keys of which texts of few shingles (rep, few) share one if their Jaccard similarity reaches the threshold.

    Of n shingles the n - ceil(threshold n) + 1 rarest; shingles that many texts hold come last and are seldom keys.
    """
    held = texts.where("few IS NOT NULL").select("rep", F.size("few").alias("size"), F.explode("few").alias("sketch"))
    ranked = held.join(held.groupBy("sketch").agg(F.count("*").alias("n")), "sketch")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("n", "sketch")))
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("rep", F.lit(-1).alias("place"), "sketch")


def _tile(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        split_at = group["block"].to_numpy() == group["left_block"].to_numpy()
        group = pd.concat([group[split_at], group[~split_at]], ignore_index=True)
        words = split_words(pa.array(group["text"], pa.large_string()))
        texts = [shingles(words.hashes[a:b], SHINGLE) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        split = int(split_at.sum())
        i, j = similar_pairs([np.unique(t) for t in texts], threshold, None if split == len(group) else split)
        root = list(range(len(group)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = find(a), find(b)
            if x != y and aligned(texts[a], texts[b], threshold) >= threshold:
                root[max(x, y)] = min(x, y)
                links.append((a, b))
        ids = group["rep"].to_numpy()
        return pd.DataFrame({"a": [ids[a] for a, _ in links], "b": [ids[b] for _, b in links]}, dtype="int64")

    return run


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_docs: int = 128) -> DataFrame:
    """doc_id, class_id, kept (and the text's digest) for every row: documents linked at the threshold or over share a class.

    class_id is the smallest doc_id of the class; kept is true for one row of each class. Texts that are equal are in one class,
    the empty one too. A null text is like nothing: its class is its own doc_id, and it is kept. Texts of fewer than five words
    are one shingle, texts without words have none and are only like equal ones. Rows without a doc_id belong to classes but
    never name them unless no row of the class has one; rows that repeat an id share the class, and one of them is kept.
    ``block_docs`` bounds the documents of a tile.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", "text", digest("text").alias("digest"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                words = split_words(part["text"])
                found, few = [], []
                for a, b in zip(words.offsets[:-1], words.offsets[1:]):
                    names = shingles(words.hashes[a:b], SHINGLE)
                    told = labelled(names)
                    own = [sketch(told)] if len(names) else []
                    firsts = names[told == names]
                    if len(firsts) < len(names):  # also without repeats, which the similarity does not count
                        own.append(sketch(firsts))
                    found.append(np.concatenate(own).view(np.int64) if own else None)
                    few.append(firsts.view(np.int64) if 0 < len(firsts) <= FEW / threshold else None)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, few)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], *lists], names=["doc_id", "digest", "sketches", "few"])

    members = keyed.where("text IS NOT NULL").mapInArrow(sketched, "doc_id long, digest binary, sketches array<long>, few array<long>")
    members = written(members.withColumn("row", F.monotonically_increasing_id()), "omh-sketches")
    texts = members.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sketches").alias("sketches"), F.first("few").alias("few"))
    texts = written(texts.withColumn("rep", F.monotonically_increasing_id()), "omh-texts")
    sketches = texts.where("sketches IS NOT NULL").select("rep", F.posexplode("sketches").alias("place", "sketch")).withColumn("place", F.col("place") % SKETCHES)
    sketches = sketches.union(written(rare_keys(texts, threshold), "omh-rare"))
    shared = sketches.groupBy("place", "sketch").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1")
    candidates = sketches.join(shared, ["place", "sketch"]).where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    clusters = written(components(candidates, "omh-clusters").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "omh-members")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block_docs).alias("blocks"))
    placed = clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = written(placed.join(texts.select("rep", "digest", "first_id"), "rep"), "omh-places")

    def linked(tiles: DataFrame, name: str) -> DataFrame:
        return written(tiles.groupBy("cluster", "left_block", "right_block").applyInPandas(_tile(threshold), "a long, b long"), name)

    def with_text(chosen: DataFrame) -> DataFrame:
        return keyed.where(likely_in(chosen, "digest")("digest")).join(chosen, "digest").where("doc_id <=> first_id").dropDuplicates(["rep"])

    # Each block by itself first, with the centre of its cluster: near copies of one text find each other without meeting in pairs.
    everywhere = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    own = with_text(placed).select("rep", "cluster", "text", F.explode(F.when(F.col("rep") == F.col("cluster"), everywhere).otherwise(F.array("block"))).alias("block"))
    links = linked(own.select("rep", "cluster", "text", "block", F.col("block").alias("left_block"), F.col("block").alias("right_block")), "omh-links")
    classes = components(links, "omh-classes").withColumnRenamed("node", "rep")
    # In a cluster of several blocks, texts apart from the centre's class then meet all others; texts inside it need not meet again.
    apart = placed.where("blocks > 1").join(classes, "rep", "left").withColumn("apart", F.coalesce("component", "rep") != F.col("cluster"))
    apart = written(apart.select("rep", "digest", "first_id", "cluster", "apart"), "omh-apart")
    n_blocks = lambda of: F.ceil(F.sum(of.cast("long")) / block_docs).cast("int")
    again = apart.groupBy("cluster").agg(n_blocks(F.col("apart")).alias("loose"), n_blocks(~F.col("apart")).alias("bound")).where("loose > 0")
    again = apart.join(again, "cluster")
    block = F.when(F.col("apart"), F.pmod(F.xxhash64("rep"), "loose")).otherwise(F.col("loose") + F.pmod(F.xxhash64("rep"), "bound")).cast("int")
    again = written(again.withColumn("block", block).withColumn("others", F.when(F.col("apart"), F.col("loose") + F.col("bound")).otherwise(F.col("loose"))), "omh-again")
    if not again.isEmpty():
        met = with_text(again).select("rep", "cluster", "block", "text", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
        met = met.select("rep", "cluster", "block", "text", F.least("block", "other").alias("left_block"), F.greatest("block", "other").alias("right_block"))
        classes = components(links.union(linked(met, "omh-more-links")), "omh-all-classes").withColumnRenamed("node", "rep")
    named = texts.select("rep", "digest", "first_id").join(classes, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    named = written(named.select("digest", "class"), "omh-named")
    members = members.select("row", "doc_id", "digest").join(named, "digest")
    order = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "row")
    first = members.groupBy("class").agg(F.min(order).alias("first"))
    found = members.join(first, "class").select("doc_id", "digest", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))
    alone = keyed.where("text IS NULL").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.union(alone).select(F.col("doc_id").alias(id_col), "class_id", "kept", F.col("digest").alias("text_digest"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, without those whose class keeps another one. Null texts stay."""
    classes = near_documents(docs.select(id_col, text_col), id_col, text_col, threshold)
    kept = written(classes.where("kept AND text_digest IS NOT NULL").select(F.col(id_col).alias("__id"), F.col("text_digest").alias("__digest")), "omh-kept")
    keyed = docs.withColumn("__text_digest", digest(text_col))
    chosen = keyed.join(kept, (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__text_digest") == F.col("__digest"))).drop("__id", "__digest")
    return chosen.dropDuplicates([id_col, "__text_digest"]).union(keyed.where(F.col(text_col).isNull())).drop("__text_digest")
