"""License scans: phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser.

One automaton runs over the words of a text and finds notice phrases; another runs over its lower-cased letters and finds
identifier tags, whose rest of the line is read as an expression: identifiers, ``and``, ``or``, ``with`` and parentheses. Both are
finite and the same for every text, a text is scanned once by each, and nothing is shuffled.

An expression is a set of choices, each a set of terms that hold together: ``or`` unites the choices of both sides, ``and`` joins
every choice of one with every choice of the other, ``with`` adds an exception to the term before it. As ``and`` over ``or`` can
double the choices, beyond MAX_CHOICES they are merged into one that holds all their terms, which changes no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winfleet.llm.common import importable, text_slices

# The phrases that count as base, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Phrases of notices without a base phrase, and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Tags after which an expression stands, in lower case.
TAGS = ("license-identifier:", "license-expression:")  # the former ends spdx-license-identifier: too
# Starts of identifiers and their labels; the longest that ends at a separator, a digit or the identifier's end decides.
FAMILIES = {
    "agpl": "agpl", "apache": "apache", "artistic": "artistic", "bsd": "bsd", "bsl": "bsl", "cc-by": "cc-by", "cc0": "cc0", "cddl": "cddl", "epl": "epl",
    "eupl": "eupl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "ofl": "ofl", "unlicense": "unlicense", "zlib": "zlib", "0bsd": "bsd",
}
BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT = 0.75, 0.75, 0.95  # how far a finding of each kind is trusted by itself
MAX_CHOICES = 64

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Choices = frozenset[frozenset[str]]


class Malformed(ValueError):
    """A text after a tag that is no expression."""


def normal_words(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, joined by one space. Null has none."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_TO_WORDS).split())


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for table, base in ((NOTICES, False), (BASE, True)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (len(phrase), label, base))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def label_of(identifier: str) -> str | None:
    """The label of a license identifier, such as gpl for gpl-2.0-or-later; None for an unknown one."""
    starts = [f for f in FAMILIES if identifier.startswith(f) and (len(identifier) == len(f) or not identifier[len(f)].isalpha())]
    return FAMILIES[max(starts, key=len)] if starts else None


def _merged(choices: Choices) -> Choices:
    return choices if len(choices) <= MAX_CHOICES else frozenset([frozenset().union(*choices)])


def _apply(operator: str, output: list[Choices]) -> None:
    if len(output) < 2:
        raise Malformed(operator)
    right, left = output.pop(), output.pop()
    if operator == "or":
        output.append(_merged(left | right))
    elif operator == "and":
        output.append(_merged(frozenset(a | b for a in left for b in right)))
    else:
        if any(len(c) != 1 for c in (*left, *right)) or len(left) != 1 or len(right) != 1:
            raise Malformed("with stands between one license and one exception")
        ((license_,),), ((exception,),) = left, right
        output.append(frozenset([frozenset([f"{license_} with {exception}"])]))


def tokens(text: str, at: int = 0) -> list[str]:
    """Operators, parentheses and identifiers from a place on in its line; what comes after (a comment's end, prose) is left.

    Two identifiers in a row end the expression before the second one.
    """
    out: list[str] = []
    depth, after_term = 0, False
    while match := _TOKEN.match(text, at):
        token = match[1] or match[2].rstrip(".:")
        starts = token == "(" or (token != ")" and token not in _PRECEDENCE)
        if after_term == starts or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        after_term = token != "(" and token not in _PRECEDENCE
        out.append(token)
        at = match.end()
    while out and out[-1] in _PRECEDENCE:
        out.pop()
    return out


def evaluate(parts: list[str]) -> Choices:
    """The choices of an expression, by two stacks: with binds before and, and before or; equal ones from the left."""
    output: list[Choices] = []
    held: list[str] = []
    for part in parts:
        if part == "(":
            held.append(part)
        elif part == ")":
            while held and held[-1] != "(":
                _apply(held.pop(), output)
            if not held:
                raise Malformed(")")
            held.pop()
        elif part in _PRECEDENCE:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[part]:
                _apply(held.pop(), output)
            held.append(part)
        else:
            output.append(frozenset([frozenset([part])]))
    while held:
        if held[-1] == "(":
            raise Malformed("(")
        _apply(held.pop(), output)
    if len(output) != 1:
        raise Malformed("no single expression")
    return output[0]


@dataclass
class Scan:
    n_words: int
    places: list[int]  # word numbers where base phrases start
    base_labels: set[str]
    labels: set[str]
    expressions: list[str]  # each with its choices, terms and choices sorted
    score: float


def scan(text: str | None) -> Scan:
    """All findings in one text. Null, empty and wordless texts have none and the score 0.

    The score joins the kinds of findings as independent hints: 1 - (1 - w1)(1 - w2)... over base phrases, other notices and
    expressions, each kind once. Tags without an expression that parses, or with unknown identifiers only, count for nothing.
    """
    phrases, tags = _automata()
    words = normal_words(text)
    padded = f" {words.decode('utf-8')} "
    found = sorted((end - length - 1, label, base) for end, (length, label, base) in phrases.iter(padded))
    places, number, seen = [], 0, 0
    for start, _, base in found:  # start is the space before the phrase
        number, seen = number + padded.count(" ", seen, start), start
        if base:
            places.append(number)
    base_labels, labels = {label for _, label, base in found if base}, {label for _, label, _ in found}
    notices, expressions = len(places) < len(found), []
    lower = (text or "").encode("utf-8", "replace").translate(_TO_LOWER).decode("utf-8")
    for end, _ in tags.iter(lower):
        try:
            choices = evaluate(tokens(lower, end + 1))
        except Malformed:
            continue
        known = {label for choice in choices for term in choice if (label := label_of(term.split(" ")[0]))}
        if known:
            labels |= known
            expressions.append(" | ".join(sorted(" & ".join(sorted(choice)) for choice in choices)))
    rest = 1.0
    for weight, holds in ((BASE_WEIGHT, places), (NOTICE_WEIGHT, notices), (TAG_WEIGHT, expressions)):
        rest *= 1 - weight if holds else 1.0
    return Scan(words.count(b" ") + 1 if words else 0, places, base_labels, labels, expressions, 1 - rest)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions.

    Words are runs of ASCII letters (A-Z in lower case), digits and all characters beyond ASCII, numbered from 0. n_base counts
    all places where a base phrase stands, overlapping ones too. Labels are distinct, sorted, comma-joined; without any the text is
    empty. A null text is empty; a null id stays; rows that repeat are scanned each.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [scan(text) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array([s.n_words for s in found], pa.int64()),
                        pa.array([len(s.places) for s in found], pa.int64()),
                        pa.array([min(s.places, default=None) for s in found], pa.int64()),
                        pa.array([max(s.places, default=None) for s in found], pa.int64()),
                        pa.array([",".join(sorted(s.base_labels)) for s in found], pa.string()),
                        pa.array([",".join(sorted(s.labels)) for s in found], pa.string()),
                        pa.array([s.score for s in found], pa.float64()),
                        pa.array([s.expressions for s in found], pa.list_(pa.string())),
                    ],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
    return rows.mapInArrow(run, f"id {id_type}, {kinds}").withColumnRenamed("id", id_col)
