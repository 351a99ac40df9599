"""Runs of periodic words in a text, by an online dynamic program over sparse diagonals.

For each word, its earlier occurrences raise the match lengths of their lags (diagonals); a diagonal that no occurrence raises ends
there, and a run is emitted if it matched for at least its lag. What follows keeps the diagonals sparse without losing a run:

* A run of length 12 or more and at least twice its period matches half its length. So a lag below 12 needs six matches in a row,
  and a lag p of 6 * 2^k or more (below twice that, a *band*) at least 6 * 2^k. Occurrences are therefore those of windows of that
  many words, named exactly by pairing the names of their halves, and within the lags of the band.
* Windows inside a run found before whose period is at most half the window are periodic themselves and occur all along it. Lags
  inside that run are multiples of its period and say nothing new. Between two such runs of equal period, a diagonal goes on
  beyond both only if their starts or their ends are its lag apart; such lags alone are raised. Where two of them touch, the lags
  that start and end inside them have their lengths by arithmetic.

So the work of a band grows with the words, not with pairs of occurrences, also for one word repeated over the whole text.
A document is one row and is held by one task; there is no shuffle. Most texts have no window of six words twice and end there.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winfleet.llm.common import importable, text_slices
from winfleet.llm.words import runs_of, split_words

LEAST = 12  # words of a run
Run = tuple[int, int, int]  # start, length, period


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: equal where both parts are."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _joined(names: np.ndarray, size: int, shift: int) -> np.ndarray:
    """Names of windows of ``size + shift`` words by their first word, from those of ``size``: one and the one ``shift`` later overlap or touch."""
    return _paired(names[: max(0, len(names) - shift)], names[shift:])


def _occurrences(names: np.ndarray, low: int, high: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) for each chosen place and each earlier one of equal name, low <= lag < high."""
    at = np.flatnonzero(chosen)
    at = at[np.argsort(names[at], kind="stable")]
    own = names[at]
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here = np.arange(1, len(at))
    back = 1
    while len(here):
        here = here[here >= back]
        lag = at[here] - at[here - back]
        near = (own[here] == own[here - back]) & (lag < high)
        here, lag = here[near], lag[near]
        wide = lag >= low
        places.append(at[here[wide]])
        lags.append(lag[wide])
        back += 1
    return np.concatenate(places), np.concatenate(lags)


def _touching(names: np.ndarray, size: int, before: Run, after: Run, low: int, high: int) -> Iterator[Run]:
    """Runs around the seam of two periodic runs that overlap or touch, for lags whose diagonals start and end inside them."""
    (s0, n0, _), (s1, n1, _) = before, after
    e0, e1 = s0 + n0, s1 + n1
    lags = np.arange(low, min(high, e1 - s0), dtype=np.int64)
    first, end = np.maximum(s1, s0 + lags), np.minimum(e1, e0 + lags)  # the later side of the diagonal
    fits = (end - first >= np.maximum(lags, size)) & (s1 != s0 + lags) & (e1 != e0 + lags)
    lags, first, end = lags[fits], first[fits], end[fits]
    same = names[first] == names[first - lags]
    for lag, a, b in zip(lags[same].tolist(), first[same].tolist(), end[same].tolist()):
        yield a - lag, b - a + lag, lag


def _band(names: np.ndarray, size: int, low: int, high: int, known: list[Run], least: int) -> Iterator[Run]:
    """Runs with periods from low to high, from the names of windows of ``size`` words and the runs of shorter periods."""
    home = np.full(len(names), -1, dtype=np.int64)  # the periodic run that holds the window
    wide = sorted(r for r in known if 2 * r[2] <= size and r[1] >= size)
    by_period: dict[int, list[int]] = defaultdict(list)
    places, lags = [], []
    for i, (start, length, period) in enumerate(wide):
        home[start : start + length - size + 1] = i
        for j in reversed(by_period[period]):
            s, n, _ = wide[j]
            if start - s >= high and start + length - s - n >= high and s + n < start:
                break  # runs of one period and this width overlap by less than it, so earlier ones end earlier
            if s + n >= start:
                yield from _touching(names, size, wide[j], wide[i], low, high)
            for lag in {start - s, start + length - s - n}:
                if low <= lag < high:
                    here = np.arange(start, start + length - size + 1)
                    here = here[here >= lag]
                    here = here[names[here] == names[here - lag]]
                    places.append(here)
                    lags.append(np.full(len(here), lag))
        by_period[period].append(i)
    found = _occurrences(names, low, high, home < 0)
    at, lag = np.concatenate([found[0], *places]), np.concatenate([found[1], *lags])
    order = np.lexsort((lag, at))
    active: dict[int, int] = {}
    last = -2
    for place, group in groupby(zip(at[order].tolist(), lag[order].tolist()), key=itemgetter(0)):
        raised: dict[int, int] = {}
        if place != last + 1:
            yield from _ended(active, last + size, least)
            active = {}
        for _, p in group:
            raised[p] = active.pop(p, size - 1) + 1
        yield from _ended(active, place - 1 + size, least)
        active, last = raised, place
    yield from _ended(active, last + size, least)


def _ended(active: dict[int, int], end: int, least: int) -> Iterator[Run]:
    """Runs of the diagonals that ended before the word ``end``."""
    for lag, matched in active.items():
        if matched >= lag and matched + lag >= least:
            yield end - matched - lag, matched + lag, lag


def runs_in(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All maximal runs (start, length, smallest period) with length >= max(least, 2 * period), by start, then period."""
    numbers = dict(zip(dict.fromkeys(words), count()))
    names = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    base = (least + 1) // 2  # matches that any run has
    size = 1
    while size < base:
        shift = min(size, base - size)
        names, size = _joined(names, size, shift), size + shift
    low, high = 1, max(2 * size, least)
    found: dict[tuple[int, int], int] = {}
    while len(words) >= max(least, 2 * low) and len(names) > names.max() + 1:  # some window occurs twice
        for start, length, period in _band(names, size, low, high, [(s, n, p) for (s, n), p in found.items()], least):
            found[start, length] = min(found.get((start, length), period), period)  # larger ones are its multiples
        low = high
        while size < low:
            shift = min(size, low - size)
            names, size = _joined(names, size, shift), size + shift
        high = 2 * low
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def with_repeats(texts: pa.Array, size: int = LEAST // 2) -> np.ndarray:
    """Which texts may hold a run: they have a window of ``size`` words twice, by 64-bit names. Equal windows have equal names, so no
    text with a run is missed."""
    words = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    names = runs_of(words.hashes, size)
    whole = owner[: len(names)] == owner[size - 1 :] if len(names) else np.zeros(0, dtype=bool)
    names, owner = names[whole], owner[: len(names)][whole]
    order = np.argsort(names, kind="stable")  # windows of one text stay together
    names, owner = names[order], owner[order]
    twice = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    out = np.zeros(len(texts), dtype=bool)
    out[owner[1:][twice]] = True
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that any run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, [s + p for s, _, p in runs], 1)
    np.add.at(edges, [s + n for s, n, _ in runs], -1)
    return b" ".join(w for w, inside in zip(words, np.cumsum(edges).tolist()) if not inside)


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_text string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, with_text: bool = True) -> DataFrame:
    """One row per row: id, n_runs, the longest run (start, length, period, exponent_milli), runs, runs_sha256, collapsed_text, collapsed_sha256.

    Words are runs of characters other than space and 0x09 to 0x0D. A run is a maximal stretch of at least ``least`` words and
    twice its smallest period; the longest is that with the smallest start, then period. runs_sha256 is over a line
    ``start,length,period`` per run. Null, empty and wordless texts have no run, four nulls and the digests of nothing. A null id stays;
    rows that repeat are taken each. Without ``with_text``, runs and collapsed_text are null.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found, texts, digests = [], [], []
                for text, may in zip(part["text"].to_pylist(), with_repeats(part["text"], (least + 1) // 2)):
                    words = (text or "").encode("utf-8", "replace").split()
                    runs = runs_in(words, least) if may else []
                    kept = collapsed(words, runs)
                    found.append(runs)
                    texts.append(kept.decode("utf-8") if with_text else None)
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    digests.append((hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                best = [min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None)) for runs in found]
                entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                spans = [[{"start": s, "length": n, "period": p} for s, n, p in runs] if with_text else None for runs in found]
                columns = {
                    "id": part["id"],
                    "n_runs": pa.array(map(len, found), pa.int64()),
                    "start": pa.array([s for s, _, _ in best], pa.int64()),
                    "length": pa.array([n for _, n, _ in best], pa.int64()),
                    "period": pa.array([p for _, _, p in best], pa.int64()),
                    "exponent_milli": pa.array([1000 * n // p if p else None for _, n, p in best], pa.int64()),
                    "runs": pa.array(spans, pa.list_(entry)),
                    "runs_sha256": pa.array([d for d, _ in digests], pa.string()),
                    "collapsed_text": pa.array(texts, pa.string()),
                    "collapsed_sha256": pa.array([d for _, d in digests], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}").withColumnRenamed("id", id_col)
