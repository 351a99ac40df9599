"""Language identification by hyperdimensional profiles.

Every letter of Unicode has its own random vector of +1 and -1, drawn by a hash of its code point. A trigram's vector binds
(multiplies) its letters' vectors, permuted (rolled) by their place; a document's vector bundles (adds) those of its trigrams, and
a language's prototype bundles its documents. The common part of all languages is taken out of both sides, and the language with
the highest cosine wins. That part holds what makes a text like any language at all, so this is judged with it left in.

As vectors are linear in trigram counts, all sums are sums of counts: tasks count trigrams per language, then bundle each once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.llm.common import importable, text_slices
from winfleet.llm.words import mix

DIMENSIONS = 1024
UNKNOWN = "und"
ERRORS = 3.0  # standard errors by which a text's fit is taken better than measured
LETTER_BITS = 21  # a code point's; a trigram is three of them in 63 bits
LETTER = np.int64((1 << LETTER_BITS) - 1)


@cache
def _symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point: its lower-case letter's code point, or 0 for what is neither a letter nor a mark written on one;
    and which are marks."""
    symbols, marks = np.zeros(0x110000, dtype=np.int32), np.zeros(0x110000, dtype=bool)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            symbols[p] = ord(c.lower()[0])
        elif unicodedata.category(c) in ("Mn", "Mc") and not unicodedata.name(c, "").startswith("VARIATION SELECTOR"):
            symbols[p], marks[p] = p, True
    return symbols, marks


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """DIMENSIONS random bits for each code point, drawn by a hash of the code point: a row of zeros (+1) and ones (-1)."""
    words = mix(mix(letters.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)


class Trigrams:
    """Bound vectors of trigrams over the letters of some of them. Signs multiply as bits are added without carry."""

    def __init__(self, trigrams: np.ndarray):
        self.letters = np.unique(np.concatenate([np.unique(trigrams >> k * LETTER_BITS & LETTER) for k in range(3)]))
        bits = letter_bits(self.letters)
        self.rolled = [np.packbits(np.roll(bits, k, axis=1), axis=1).view(np.uint64) for k in range(3)]

    def bits(self, trigrams: np.ndarray) -> np.ndarray:
        """Rows of 0 (for +1) and 1 (for -1)."""
        first, second, third = (rolled[np.searchsorted(self.letters, trigrams >> k * LETTER_BITS & LETTER)] for k, rolled in zip((2, 1, 0), reversed(self.rolled)))
        return np.unpackbits((first ^ second ^ third).view(np.uint8), axis=1)


def trigrams_of(text: str) -> np.ndarray:
    """Trigram numbers over a text's letters, other characters reading as one space; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    table, marks = _symbol_table()
    symbols = table[points]
    if not np.any((symbols != 0) & ~marks[points]):
        return np.zeros(0, dtype=np.int64)
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    return symbols[:-2] << 2 * LETTER_BITS | symbols[1:-1] << LETTER_BITS | symbols[2:]


def trigram_counts(rows: DataFrame) -> DataFrame:
    """lang, trigram, n over rows of lang and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def merge() -> None:
            for lang, grams in waiting.items():
                own, n = np.unique(np.concatenate(grams), return_counts=True)
                if lang in sums:
                    old, before = sums[lang]
                    own, at = np.unique(np.concatenate([old, own]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([before, n])).astype(np.int64)  # sums below 2**53 are exact
                sums[lang] = own, n
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, (own, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n.astype(np.int64))], names=["lang", "trigram", "n"])
            sums.clear()

        held = 0
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                    grams = trigrams_of(text)
                    waiting.setdefault(lang, []).append(grams)
                    held += len(grams)
                if held > 2_000_000:
                    merge()
                    held = 0
                    if sum(len(own) for own, _ in sums.values()) > 2_000_000:
                        yield from flush()
        yield from flush()

    return rows.mapInArrow(count, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def bundles(rows: DataFrame) -> DataFrame:
    """lang, place, total: the sum of the vectors of all trigrams of a language at each place, and their number at place -1.

    Sums of whole numbers, so they do not depend on how rows are spread.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            codes = langs.indices.to_numpy()
            trigrams, n = batch["trigram"].to_numpy(), batch["n"].to_numpy().astype(np.float64)
            vectors = Trigrams(trigrams) if len(trigrams) else None
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                total = sums.setdefault(lang, np.zeros(DIMENSIONS + 1))
                total[0] += n[own].sum()
                for k in range(0, len(own), 4096):
                    part = own[k : k + 4096]
                    total[1:] += n[part].sum() - 2 * (n[part] @ vectors.bits(trigrams[part]).astype(np.float64))
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(np.arange(-1, DIMENSIONS)), pa.array(total.astype(np.int64))], names=["lang", "place", "total"])

    return trigram_counts(rows).mapInArrow(bundle, "lang string, place long, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))


@dataclass
class Model:
    langs: list[str]  # in order
    prototypes: np.ndarray  # unit vectors without the common part
    common: np.ndarray  # taken out of every document
    means: np.ndarray  # the mean trigram vector of each language, with the common part


def learn(rows: DataFrame) -> Model:
    """What rows of lang and text teach. A vector for each language reaches the driver, whatever the rows and their letters."""
    importable(rows.sparkSession)
    found = bundles(rows.where("lang IS NOT NULL AND text IS NOT NULL")).where("place >= 0 OR total > 0").toPandas()
    langs = sorted(found.loc[found["place"] < 0, "lang"].unique())
    found = found[found["lang"].isin(langs)]
    sums = np.zeros((len(langs), DIMENSIONS + 1))
    if len(langs):
        sums[np.searchsorted(langs, found["lang"].to_numpy(dtype=str)), found["place"].to_numpy(dtype=np.int64) + 1] = found["total"].to_numpy(dtype=np.float64)
    means = sums[:, 1:] / np.maximum(sums[:, :1], 1)
    common = means.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    prototypes = means - common
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(langs, prototypes / np.where(norms > 0, norms, 1), common, means)


def text_vectors(grams: list[np.ndarray]) -> np.ndarray:
    """Mean trigram vector of each text, none of them empty.

    Trigrams that many of the texts hold go through a matrix product, a few thousand at a time; the others are added text by text.
    Memory is bounded by the texts' length, whatever the number of different trigrams.
    """
    lengths = np.array([len(g) for g in grams])
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), lengths)
    vectors = Trigrams(known)
    total = np.zeros((len(grams), DIMENSIONS))  # of bits
    occurrences = np.bincount(at, minlength=len(known))
    often = occurrences * 25 >= len(grams)
    column_of = np.cumsum(often) - 1
    dense, columns = often[at], np.flatnonzero(often)
    rows_of, column = row[dense], column_of[at[dense]]
    order = np.argsort(column, kind="stable")
    rows_of, column = rows_of[order], column[order]
    for k in range(0, len(columns), 4096):
        width = min(4096, len(columns) - k)
        low, high = np.searchsorted(column, [k, k + width])
        counts = np.bincount(rows_of[low:high] * width + column[low:high] - k, minlength=len(grams) * width).reshape(len(grams), width)
        total += counts.astype(np.float32) @ vectors.bits(known[columns[k : k + width]]).astype(np.float32)
    rest = np.flatnonzero(~dense)
    for k in range(0, len(rest), 4096):
        part = rest[k : k + 4096]
        texts, first = np.unique(row[part], return_index=True)
        total[texts] += np.add.reduceat(vectors.bits(known[at[part]]), first, axis=0, dtype=np.int32)
    return 1 - 2 * total / lengths[:, None]


def predict_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (the best cosine, at least 0) and fit of each text.

    The cosine tells languages from each other; the fit tells how far the text is like the chosen one at all (see ``fits``).
    """
    grams = [trigrams_of(t) for t in texts]
    found, scores, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    filled = [i for i, g in enumerate(grams) if len(g)]
    if not filled or not model.langs:
        return found, scores, fit
    whole = text_vectors([grams[i] for i in filled])
    vectors = whole - model.common
    norms = np.linalg.norm(vectors, axis=1)
    cosines = (vectors @ model.prototypes.T) / np.where(norms > 0, norms, 1)[:, None]
    best = cosines.argmax(axis=1)
    scores[filled] = np.clip(cosines[np.arange(len(filled)), best], 0.0, 1.0)
    fit[filled] = fits([grams[i] for i in filled], best, model)
    for k, i in enumerate(filled):
        found[i] = model.langs[best[k]]
    return found, scores, fit


def fits(grams: list[np.ndarray], best: np.ndarray, model: Model) -> np.ndarray:
    """How like its chosen language each text can be at most: 1 is what that language's own texts are on average.

    A trigram's likeness is its product with the language's mean vector, as a share of that vector's with itself. The mean over a
    text is raised by ERRORS standard errors, which fall with the number of distinct trigrams, as repeats tell nothing new. So a few
    words, or few again and again, are given the benefit of the doubt, and long texts that are no language, or one never learned, are not.
    """
    lengths = np.array([len(g) for g in grams])
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), lengths)
    own = (model.means**2).sum(axis=1)
    vectors = Trigrams(known)
    means = model.means.astype(np.float32)
    products = np.empty((len(known), len(model.langs)))
    for k in range(0, len(known), 4096):
        products[k : k + 4096] = means.sum(axis=1) - 2 * (vectors.bits(known[k : k + 4096]).astype(np.float32) @ means.T)
    values = products[at, best[row]] / own[best[row]]
    mean = np.bincount(row, values) / lengths
    spread = np.maximum(np.bincount(row, (values - mean[row]) ** 2) / lengths, 1 / own[best])  # random vectors alone give the latter
    distinct = np.array([len(np.unique(g)) for g in grams])
    return mean + ERRORS * np.sqrt(spread / distinct)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs with lang_pred, score and fit; no column but the text is read for them.

    ``und`` with score and fit 0 if the text is null or has no letter, or if nothing was learned. Extra columns are passed through;
    a column of docs that is already called so is replaced. Texts are read whole, whatever their length.
    """
    docs = docs.drop(*({"lang_pred", "score", "fit"} & set(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                for part in text_slices(batch.slice(k, 1000), text_col, 1_000_000):
                    found, scores, fit = predict_texts([t or "" for t in part[text_col].to_pylist()], model)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores), pa.array(fit)], names=[*part.schema.names, "lang_pred", "score", "fit"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out and have a language.

    Rows with a null id have held_out false and teach, repeated rows are predicted each, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = learn(rows.where(~held_out()).select("lang", "text"))
    return predicted(rows.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text", "fit")
