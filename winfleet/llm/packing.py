"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it and a rest. Pieces are dealt by a hash into groups of a
bounded size, and each group is packed by itself: longest first, into the open bin with the least room that still holds the
piece. Where none does, a bin is opened at the length whose cost per word is least, given what is still to come and could fill
it. In the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winfleet.llm.common import written

LENGTHS = (512, 1024, 2048, 4096)
WORD = r"[^\x20\x09-\x0D]+"
# Equal rows that one task numbers at a time.
LOT = 10_000


def word_count(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pack(sizes: np.ndarray, lengths: tuple[int, ...], overhead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin, and final length of the bin for each size; sizes must descend and fit the largest length.

    ``overhead`` is what a sequence costs besides its length, in words.
    """
    lengths = tuple(sorted(lengths))
    still = np.cumsum(sizes[::-1])[::-1] - sizes if len(sizes) else sizes
    bins, places = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[int] = []
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    free = 0  # bit r is set if an open bin has room for exactly r
    for i, size in enumerate(sizes.tolist()):
        above = free >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            chosen = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            fits = [c for c in lengths if c >= size]
            r = min(fits, key=lambda c: ((overhead + c) / min(c, size + int(still[i])), c))
            chosen = len(room)
            room.append(r)
            used.append(0)
        bins[i], places[i] = chosen, used[chosen]
        used[chosen] += size
        room[chosen] = r = r - size
        if r:
            by_room.setdefault(r, []).append(chosen)
            free |= 1 << r
    final = np.array(lengths)[np.searchsorted(lengths, np.array(used, dtype=np.int64))] if used else np.zeros(0, dtype=np.int64)
    return bins, places, final[bins] if used else final


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: float = 64.0, group_pieces: int = 8192) -> DataFrame:
    """One row per piece: id, piece, piece_start, piece_words, bin_id, bin_start, bin_words, bin_length.

    ``piece_start`` and ``piece_words`` count words of the document, ``bin_start`` is the piece's place in its bin. bin_id is text:
    group and number. Documents without words (null or empty) have no piece. Repeated rows are packed once per row. The number of
    groups follows the number of pieces, so a group holds about ``group_pieces`` of them; a larger group fills its bins better.
    The result follows from the rows alone, however they are partitioned.
    """
    top = max(lengths)
    sizes = docs.select(F.col(id_col).alias("id"), word_count(text_col).alias("words"), F.xxhash64(id_col, text_col).alias("deal")).where("words > 0")
    # Rows that repeat exactly are counted and then numbered, so that each goes to a group of its own: first in lots, then
    # within lots, which are dealt to tasks in between.
    lots = sizes.groupBy("id", "words", "deal").agg(F.count("*").alias("rows"))
    lots = written(lots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {LOT}"))).alias("lot")), "pack-sizes")
    n = lots.agg(F.sum(F.least(F.lit(LOT), F.col("rows") - F.col("lot") * LOT) * F.expr(f"(words - 1) div {top} + 1"))).first()[0] or 0
    groups = max(1, -(-n // group_pieces))
    copies = lots.repartition("deal", "lot").select("id", "words", "deal", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("rows"), F.col("lot") * LOT + LOT) - 1)).alias("copy"))
    pieces = copies.select("id", "words", "deal", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {top}"))).alias("piece"))
    pieces = pieces.select("id", "deal", "copy", "piece", (F.col("piece") * top).alias("piece_start"), F.least(F.lit(top), F.col("words") - F.col("piece") * top).cast("long").alias("piece_words"))
    pieces = pieces.withColumn("bin_group", F.pmod(F.xxhash64("deal", "piece", "copy"), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["piece_words", "deal", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        bins, places, final = pack(group["piece_words"].to_numpy(), lengths, overhead)
        group["bin_id"] = group["bin_group"].astype(str) + "-" + pd.Series(bins).astype(str)
        group["bin_start"], group["bin_length"] = places, final
        group["bin_words"] = group.groupby("bin_id")["piece_words"].transform("sum")
        return group[["id", "piece", "piece_start", "piece_words", "bin_id", "bin_start", "bin_words", "bin_length"]]

    id_type = sizes.schema["id"].dataType.simpleString()
    packed = pieces.groupBy("bin_group").applyInPandas(run, f"id {id_type}, piece long, piece_start long, piece_words long, bin_id string, bin_start long, bin_words long, bin_length long")
    return packed.withColumnRenamed("id", id_col)
