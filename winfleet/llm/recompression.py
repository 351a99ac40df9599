"""Repeated passages by recompression: equal runs of words get equal names, and shared names show where long repeats are.

A text is a sequence of symbols, at first its words. A round names every run of equal symbols, then every pair of a left and a
right symbol (a bit of a symbol's name says which it is), and goes on with the shorter sequence. Names are 64-bit hashes of what
they stand for, so that all tasks name alike without asking each other. Every symbol knows the words its forming looked at; where
all of them are inside a window of words, any other occurrence of that window has formed the same symbol at the same place.

Each window of words is given to the highest such symbol inside it (ties by hash), together with the words it looked at: its
anchor. Equal windows have equal anchors. Spark counts anchors over the corpus; only windows whose anchor occurs in several texts
can repeat, and only those are compared by names of their own, of 128 bits: a hash of the names of their words, and another one
of other names of their words, so that words that share a name by chance do not share the other. Equal texts are one text in this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.llm.common import digest, likely_in, text_slices, written
from winfleet.llm.words import Words, mix, runs_of, split_words

WINDOW = 13
ROUNDS = 2
# A window in this many places or more is hot, and dealt to this many tasks.
HOT, SALTS = 1000, 32
_RUN, _PAIR, _SECOND = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FAR = 1 << 40


def _prefix_names(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which the name of any run of words follows."""
    powers = np.multiply.accumulate(np.full(len(hashes) + 1, _SECOND))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers[:-1])])
    return sums, powers


def anchors(words: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of words, by the window's first word, and which first words have a window inside their text."""
    n = len(words.hashes)
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    has_window = np.arange(n) + window <= np.append(words.offsets[1:], 0)[text] if n else np.zeros(0, dtype=bool)
    best = np.full(n, _NONE)
    if n == 0:
        return best, has_window
    # ends of what a symbol looked at; a look over the end of the text is no place inside it
    name, owner = words.hashes, text
    low, high = np.arange(n), np.arange(n) + 1
    by_length = [np.full(n, _NONE) for _ in range(window + 1)]
    # A product with the inverse of a power moves a run to the front; powers of an odd number have one.
    sums, powers = _prefix_names(words.hashes)
    inverse = np.multiply.accumulate(np.full(n + 1, np.uint64(pow(int(_SECOND), -1, 1 << 64))))

    def offer(level: int) -> None:
        length = high - low
        on = np.flatnonzero((length <= window) & (low >= 0))
        a, b = low[on], high[on]
        looked = (sums[b] - sums[a]) * inverse[a]
        score = (mix(looked ^ mix(name[on] + length[on].astype(np.uint64))) >> np.uint64(3)) | (np.uint64(rounds - level) << np.uint64(61))
        for size in np.unique(length[on]):
            same = length[on] == size
            np.minimum.at(by_length[size], a[same], score[same])

    for level in range(1, rounds + 1):
        # runs of equal symbols
        starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]))
        ends = np.append(starts[1:], len(name))
        count = (ends - starts).astype(np.uint64)
        left_known = np.concatenate([[False], owner[starts[1:]] == owner[starts[1:] - 1]])
        right_known = np.append(left_known[1:], False)
        run_low = np.where(left_known, low[np.maximum(starts - 1, 0)], -_FAR)
        run_high = np.where(right_known, high[np.minimum(ends, len(name) - 1)], _FAR)
        run_name = name[starts]
        run_name = np.where(count > 1, mix(run_name ^ (count * _RUN)), run_name)
        name, owner, low, high = run_name, owner[starts], run_low, run_high
        # pairs of a left and a right symbol
        left = (mix(name + np.uint64(level)) & np.uint64(1)).astype(bool)
        joined = np.append((owner[1:] == owner[:-1]) & left[:-1] & ~left[1:], False)
        second = np.concatenate([[False], joined[:-1]])
        next_low, next_high = np.append(low[1:], -_FAR), np.append(high[1:], _FAR)
        prev_low, prev_high = np.concatenate([[-_FAR], low[:-1]]), np.concatenate([[_FAR], high[:-1]])
        same_next = np.append(owner[1:] == owner[:-1], False)
        same_prev = np.concatenate([[False], owner[1:] == owner[:-1]])
        # A left symbol looks at the next one, a right symbol at the one before.
        other_low = np.where(left, np.where(same_next, next_low, -_FAR), np.where(same_prev, prev_low, -_FAR))
        other_high = np.where(left, np.where(same_next, next_high, _FAR), np.where(same_prev, prev_high, _FAR))
        pair_name = mix(name * _PAIR + np.append(name[1:], np.uint64(0)))
        keep = ~second
        name = np.where(joined, pair_name, name)[keep]
        low, high, owner = np.minimum(low, other_low)[keep], np.maximum(high, other_high)[keep], owner[keep]
        offer(level)
    for size in range(1, window + 1):
        shifted = np.append(best[1:], _NONE)
        best = np.minimum(np.minimum(best, shifted), by_length[size])
    # Windows in which no symbol is settled, as inside one long run, stand for themselves.
    bare = np.flatnonzero((best == _NONE) & has_window)
    if len(bare):
        best[bare] = (mix((sums[bare + window] - sums[bare]) * inverse[bare]) >> np.uint64(3)) | (np.uint64(7) << np.uint64(61))
    return best, has_window


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, digest, marks: for every text that loses words, the first words (0-based) of the windows that go; null: all of it.

    A window goes if its words also start in a text with a smaller doc_id. Rows with a null id neither lose words nor cost others
    theirs. Rows of equal id are the same document in this respect.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("digest", digest("text"))
    first = keyed.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # Only texts with copies need a look-up, so this table is small where there are few.
    copied = written(first.where("first_id < last_id").select(F.col("digest"), "first_id"), "repeat-copies")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                words = split_words(part["text"])
                best, has_window = anchors(words, window)
                found = [np.unique(best[a:b][has_window[a:b]]).view(np.int64) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "anchors"])

    listed = written(keyed.mapInArrow(find, "doc_id long, digest binary, anchors array<long>"), "repeat-anchors")
    originals = listed.join(copied, "digest", "left").where("first_id IS NULL OR doc_id = first_id").drop("first_id")
    each = originals.select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    asked = written(each.join(shared, "anchor").groupBy("doc_id", "digest").agg(F.collect_set("anchor").alias("shared")), "repeat-shared")
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("at", T.LongType()), T.StructField("name", T.LongType()), T.StructField("second", T.LongType())]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                words = split_words(part["text"], twice=True)
                best, has_window = anchors(words, window)
                best = best.view(np.int64)
                texts, places, names, seconds = [], [], [], []
                for k, shared_here in enumerate(part["shared"]):
                    a, b = words.offsets[k], words.offsets[k + 1]
                    at = np.flatnonzero(has_window[a:b] & np.isin(best[a:b], shared_here.values.to_numpy()))
                    one, two = runs_of(words.hashes[a:b], window).view(np.int64), runs_of(words.seconds[a:b], window, _SECOND).view(np.int64)
                    texts.append(np.full(len(at), k))
                    places.append(at)
                    names.append(one[at])
                    seconds.append(two[at])
                rows = pa.array(np.concatenate(texts))
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(rows), part["digest"].take(rows), *(pa.array(np.concatenate(x), pa.int64()) for x in (places, names, seconds))], names=[f.name for f in fields])

    texts = keyed.join(asked, ["doc_id", "digest"])
    named = written(texts.select("doc_id", "digest", "text", "shared").mapInArrow(windows, T.StructType(fields)), "repeat-windows")
    earliest = named.groupBy("name", "second").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    earliest = written(earliest.select("name", "second", "low", "n"), "repeat-earliest")
    # A passage in very many texts: its windows are dealt by place, and its earliest text goes to all of those tasks.
    hot = likely_in(earliest.where(F.col("n") >= HOT), "name")
    dealt = named.withColumn("salt", F.when(hot("name"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))).otherwise(0))
    salts = F.when(hot("name"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = earliest.select("name", "second", "low", F.explode(salts).alias("salt"))
    gone = dealt.join(spread, ["name", "second", "salt"]).where("low < doc_id").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("at")).alias("marks"))
    copies = listed.select("doc_id", "digest").join(copied, "digest").where("doc_id > first_id").select("doc_id", "digest", F.lit(None).cast("array<long>").alias("marks")).distinct()
    return written(gone.union(copies), "repeat-marks")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of docs, and n_words, n_removed, kept_text, kept_sha256 for every row.

    Words are runs of characters other than space and U+0009 to U+000D. A word goes if a window of ``window`` words that covers it
    also starts in a document with a smaller id; kept words are joined by one space. A null or empty text has no words and keeps
    the empty text. Columns of docs that are called like the new ones are replaced.
    """
    names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    docs = docs.drop(*(set(names) & set(docs.columns)))
    marks = repeated_words(docs.select(id_col, text_col), id_col, text_col, window)
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("marks").alias("__marks"), F.lit(True).alias("__marked"))
    keyed = docs.withColumn("__text_digest", digest(text_col))
    joined = keyed.join(marks, (F.col(id_col) == F.col("__id")) & (F.col("__text_digest") == F.col("__digest")), "left").drop("__id", "__digest", "__text_digest")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])

    columns_of_docs = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                for part in text_slices(batch.slice(k, 1000), text_col, 1_000_000):
                    words = split_words(part[text_col])
                    raw = words.data.tobytes()
                    columns: tuple[list, list, list, list] = ([], [], [], [])
                    for i, (marked, at) in enumerate(zip(part["__marked"].to_pylist(), part["__marks"])):
                        a, b = words.offsets[i], words.offsets[i + 1]
                        gone = np.zeros(b - a, dtype=bool)
                        if marked and at.is_valid:
                            edge = np.zeros(b - a + 1, dtype=np.int64)
                            places = at.values.to_numpy()
                            edge[places] += 1
                            edge[places + window] -= 1
                            gone = np.cumsum(edge[:-1]) > 0
                        elif marked:
                            gone[:] = b - a >= window
                        keep = np.flatnonzero(~gone) + a
                        kept = b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())])
                        for column, value in zip(columns, (int(b - a), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest())):
                            column.append(value)
                    own = [part[c] for c in columns_of_docs]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=[*columns_of_docs, *names])

    return joined.mapInArrow(cut, schema)
