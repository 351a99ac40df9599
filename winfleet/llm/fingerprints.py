"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, and likeness of versions by peeling.

A text is cut into paragraphs: its lines, and long lines further at sentence ends or, where a line has none, after words picked by
their hash. Each paragraph's digest, labelled with its occurrence in the text, is added to three cells of a sketch (number, xor of
digests, xor of checks). Sketches of two versions subtract cell by cell; what they share cancels, and the rest is peeled: a cell
that holds one digest gives it away, and it is taken out of its other cells. If some cells stay full, a sketch twice as large is
taken, until all differing digests are known. All texts of a batch are sketched and peeled together in arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winfleet.llm.words import mix

CELLS = 24  # of the fingerprint itself and of the first comparison
HASHES = 3
_SENTENCE = re.compile(r"[^\n.!?]*[.!?]+|[^\n.!?]+")
_WORDS = re.compile(r"\s*\S+")
LONG = 240  # characters of a piece without sentence end, from which it is cut after picked words


def paragraphs(text: str) -> list[str]:
    out = []
    for piece in _SENTENCE.findall(text):
        piece = piece.strip()
        if len(piece) <= LONG:
            if piece:
                out.append(piece)
            continue
        held: list[str] = []
        for word in _WORDS.findall(piece):
            held.append(word)
            if sum(word.encode("utf-8", "surrogatepass")) % 8 == 0:
                out.append("".join(held).strip())
                held = []
        if held:
            out.append("".join(held).strip())
    return out


def labelled_digests(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph, told apart by its occurrence in the text."""
    parts = paragraphs(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in parts), dtype="<u8")
    order = np.argsort(raw, kind="stable")
    ordered = raw[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    out = np.empty(len(raw), dtype=np.uint64)
    out[order] = mix(ordered + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _cells(digests: np.ndarray, size: int) -> np.ndarray:
    """The cells of each digest: one in each third of the sketch. They depend on the size, so a larger sketch deals anew."""
    third = size // HASHES
    return np.stack([mix(digests ^ np.uint64(size * 16 + k)) % np.uint64(third) + np.uint64(k * third) for k in range(HASHES)], axis=1).astype(np.int64)


def _check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(0xFFFFFFFF)


def sketches(owners: np.ndarray, digests: np.ndarray, signs: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, digests and checks of the cells of n sketches, from digests and the sketch each is added to (or, sign -1, taken from)."""
    at = (owners[:, None] * size + _cells(digests, size)).ravel()
    number, keys, checks = np.zeros(n * size, dtype=np.int64), np.zeros(n * size, dtype=np.uint64), np.zeros(n * size, dtype=np.uint64)
    np.add.at(number, at, np.repeat(signs, HASHES))
    np.bitwise_xor.at(keys, at, np.repeat(digests, HASHES))
    np.bitwise_xor.at(checks, at, np.repeat(_check(digests), HASHES))
    return number, keys, checks


def peel(number: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many differing digests each of n difference sketches gave, and whether it was emptied. Changes the arrays."""
    found = np.zeros(n, dtype=np.int64)
    look = np.arange(len(number))
    while True:
        look = look[np.abs(number[look]) == 1]
        look = look[_check(keys[look]) == checks[look]]
        if not len(look):
            break
        owners, values, signs = look // size, keys[look], number[look]
        # The same digest may show in several cells at once.
        order = np.lexsort((values, owners))
        keep = np.concatenate([[True], (owners[order][1:] != owners[order][:-1]) | (values[order][1:] != values[order][:-1])])
        owners, values, signs = owners[order][keep], values[order][keep], signs[order][keep]
        np.add.at(found, owners, 1)
        at = (owners[:, None] * size + _cells(values, size)).ravel()
        np.subtract.at(number, at, np.repeat(signs, HASHES))
        np.bitwise_xor.at(keys, at, np.repeat(values, HASHES))
        np.bitwise_xor.at(checks, at, np.repeat(_check(values), HASHES))
        look = np.unique(at)
    left = ((number != 0) | (keys != 0) | (checks != 0)).reshape(n, size).any(axis=1)
    return found, ~left


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of labelled digests that are in one and not in the other, for each pair; larger sketches for those that do not peel."""
    out = np.zeros(len(left), dtype=np.int64)
    todo = np.arange(len(left))
    size = CELLS
    while len(todo):
        if size > 64 * max(len(left[i]) + len(right[i]) for i in todo) + 1024:
            for i in todo:  # digests that no sketch of any size tells apart
                out[i] = len(np.setxor1d(left[i], right[i]))
            break
        sides = [left[i] for i in todo] + [right[i] for i in todo]
        lengths = np.array([len(s) for s in sides])
        owners = np.repeat(np.concatenate([np.arange(len(todo))] * 2), lengths)
        signs = np.repeat(np.repeat(np.array([1, -1]), len(todo)), lengths)
        found, done = peel(*sketches(owners, np.concatenate(sides), signs, len(todo), size), len(todo), size)
        out[todo[done]] = found[done]
        todo, size = todo[~done], size * 2
    return out


def fingerprints(digests: list[np.ndarray]) -> list[str]:
    """The sketch of CELLS cells of each text, as text."""
    n = len(digests)
    owners = np.repeat(np.arange(n), [len(d) for d in digests])
    values = np.concatenate(digests) if n else np.zeros(0, dtype=np.uint64)
    number, keys, checks = sketches(owners, values, np.ones(len(values), dtype=np.int64), n, CELLS)
    cells = np.zeros(n * CELLS, dtype=[("number", "<u2"), ("key", "<u8"), ("check", "<u4")])
    cells["number"], cells["key"], cells["check"] = number & 0xFFFF, keys, checks
    width = CELLS * cells.itemsize
    raw = cells.tobytes()
    return [base64.b64encode(raw[i * width : (i + 1) * width]).decode() for i in range(n)]


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Share of paragraphs in common, of both texts together; 1 for two texts without paragraphs."""
    both = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.float64)
    return np.where(both > 0, 1 - differences(left, right) / np.where(both > 0, both, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters from the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """doc_id, text, guest: rows in partitions by ranges of (doc_id, text hash), each sorted and closed by a guest, which is the first
    row of the next range; after the last range comes the first row of all.

    Bounds are keys of about ``sample_rows`` sampled rows, so only those come to the driver; every row is dealt by them. Null
    ids stand first, and rows of one id are spread by the hashes of their texts. Texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("number"), F.xxhash64("text").alias("tie")).alias("key"))
    n, first = rows.agg(F.count("*"), F.min("key")).first()
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = rows.select("key.*").sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=4).limit(2 * sample_rows).collect()
    keys = sorted({tuple(r) for r in sampled})
    bounds = sorted({tuple(first), *keys[:: max(1, -(-len(keys) // wanted))]}) if n else []
    held = [np.array([b[k] for b in bounds], dtype=np.int64) for k in range(3)]

    @F.pandas_udf("rank int, bound boolean")
    def place_of(known: pd.Series, number: pd.Series, tie: pd.Series) -> pd.DataFrame:
        """How many bounds are not above the key, and whether it is one of them."""
        columns = [np.concatenate([h, c.to_numpy(dtype=np.int64)]) for h, c in zip(held, (known, number, tie))]
        order = np.lexsort(columns[::-1])
        ranks = np.empty(len(order), dtype=np.int32)
        ranks[order] = np.cumsum(order < len(bounds))
        ranks = ranks[len(bounds) :]
        bound = np.all([h[ranks - 1] == c for h, c in zip(held, (known, number, tie))], axis=0)
        return pd.DataFrame({"rank": ranks, "bound": bound})

    count = max(1, len(bounds))
    ranked = rows.withColumn("rank", place_of("key.known", "key.number", "key.tie"))
    places = F.when(F.col("rank.bound"), F.array(F.struct(F.lit(0).alias("guest"), (F.col("rank.rank") - 1).alias("bucket")), F.struct(F.lit(1).alias("guest"), F.pmod(F.col("rank.rank") - 2, F.lit(count)).alias("bucket"))))
    places = places.otherwise(F.array(F.struct(F.lit(0).alias("guest"), (F.col("rank.rank") - 1).alias("bucket"))))
    dealt = ranked.select("doc_id", "text", "key", F.explode(places).alias("place")).repartitionById(count, F.col("place.bucket"))
    return dealt.sortWithinPartitions("place.guest", "key").select("doc_id", "text", F.col("place.guest").alias("guest"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A document is followed by the next in ascending order of id, the last by the first; a single one follows itself. A null
    text is an empty one. Equal texts have equal fingerprints, and likeness 1. Where the fingerprints as returned do not peel,
    likeness comes from larger sketches of the texts' paragraph digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        marks: list[np.ndarray] = []

        def compare() -> pa.RecordBatch:
            n = len(texts) - 1
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
            changed_marks = [labelled_digests(t) for t in changed]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
                    pa.array(fingerprints(marks[:n]), pa.string()),
                    pa.array(fingerprints(changed_marks), pa.string()),
                    pa.array(likeness(marks[:n], changed_marks)),
                    pa.array(likeness(marks[:n], marks[1:])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            del ids[:n], texts[:n], marks[:n]
            return out

        size, over = 0, False
        for batch in batches:
            for doc_id, text, guest in zip(batch["doc_id"], batch["text"], batch["guest"].to_pylist()):
                if over:
                    break
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                marks.append(labelled_digests(texts[-1]))
                size += len(texts[-1])
                over = guest == 1
                if over or len(texts) > 256 or size > 2_000_000:
                    yield compare()
                    size = 0
        if len(texts) > 1:
            yield compare()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
