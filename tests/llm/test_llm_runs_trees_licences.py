"""Periodic runs, Merkle manifest and license scans against plain versions, on small tables with awkward rows."""

import hashlib
import random
import re
import time
import zlib

import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winfleet.llm import licences, merkle, periodic
from winfleet.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = f"{TESTDATA}/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, runs int, labels int, tree int, digest int, rank int, id int"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def plain_runs(words, least):
    """Every diagonal of the text compared with itself; of equal stretches the smallest period stays."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 14), st.integers(0, 4)), max_size=7)


@settings(max_examples=300, deadline=None)
@given(pieces, st.integers(1, 3), st.sampled_from([12, 12, 2, 3, 5, 7, 8]))
def test_runs_equal_all_diagonals(parts, times, least):
    words = [b"%d" % x for block, k, more in parts for x in block * k + block[:more]] * times
    assert periodic.runs_in(words[:400], least) == plain_runs(words[:400], least)


@pytest.mark.parametrize("words", [["w"] * 200_000, (["w"] * 60_000 + ["x"]) * 3, ["a", "b"] * 40_000 + ["a"] + ["a", "b"] * 40_000])
def test_runs_of_long_repetitive_texts_take_linear_time(words):
    start = time.perf_counter()
    assert periodic.runs_in([w.encode() for w in words])
    assert time.perf_counter() - start < 30


def plain_report(doc_id, text):
    words = WORD.findall(text or "")
    runs = plain_runs(words, 12)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


ODD = [None, "", " \n\t\v ", "a", "a b " * 6, "a b " * 5, "one " * 12, "one " * 11, "é　x " * 20, "x" * 9000, "p q r " * 9 + "p q s", "\x1c \x85 \x1c \x85 " * 4, "w " * 3000, ("w " * 20 + "v ") * 6]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(150))) for _ in range(30)]
    rows = [(i if i % 13 else None, t, (None, "b", "a", "hot", "hot", "hot", "")[i % 7], ("en", None)[i % 2], i if i % 3 else None, 0, 0, 0, 0, 0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:9] + rows[3:4] * 12, DOCS).repartition(4).cache()


def test_periodic_runs(spark, docs):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.periodic_runs(docs)
    assert rows_of(got.select(columns)) == sorted((plain_report(r.doc_id, r.text) for r in docs.collect()), key=repr)
    for row in got.collect():
        assert sha("".join(f"{r.start},{r.length},{r.period}\n" for r in row.runs)) == row.runs_sha256 and sha(row.collapsed_text) == row.collapsed_sha256
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_periodic_runs_query(spark):
    wanted = []
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        wanted.append((r.doc_id, periodic.runs_in([w.encode() for w in words]), words))
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(wanted) and sum(r.n_runs > 0 for r in got.values()) > 10
    for doc_id, runs, words in wanted:
        if len(words) < 700:
            assert plain_report(doc_id, " ".join(words)) == tuple(got[doc_id])
        assert got[doc_id].n_runs == len(runs)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_tree(rows):
    """leaf, subroot, root, proof text for each row, from lists in memory."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def raised(nodes):
        paths, at = [""] * len(nodes), list(range(len(nodes)))
        while len(nodes) > 1:
            for i, place in enumerate(at):
                run = nodes[place // 3 * 3 : place // 3 * 3 + 3]
                paths[i] += "".join(d for k, d in enumerate(run) if k != place % 3)
            at = [place // 3 for place in at]
            nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        return nodes[0], paths

    def order(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)

    sources = sorted({r[1] for r in rows}, key=order)
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (order(r[0]), leaf(r)))
        trees.append((own, *raised([leaf(r) for r in own])))
    root, over = raised([t[1] for t in trees]) if trees else (None, [])
    return sorted(((r[0], leaf(r), sub, root, sha(p + q)) for (own, sub, paths), q in zip(trees, over) for r, p in zip(own, paths)), key=repr)


def checked(frame):
    leaves = frame.select("source", "doc_id", merkle.leaf_digest([F.col(c) for c in COLUMNS]).alias("leaf"), F.col("n_chars").alias("carried"))
    built = merkle.manifest(leaves, carry=["doc_id", "carried"])
    rows = merkle.paths(built).withColumn("root", F.lit(built.root).cast("string"))
    # Any other leaf leads elsewhere, the own one to the root.
    for r in rows.select("root", merkle.folded("path", "leaf").alias("a"), merkle.folded("path", F.sha2("leaf", 256)).alias("b")).collect():
        assert r.a == r.root != r.b
    return rows_of(rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("path")))


def test_manifest(spark, docs):
    every = [tuple(r) for r in docs.select(COLUMNS).collect()]
    assert checked(docs) == plain_tree(every)
    for n, source in ((1, "a"), (3, "a"), (4, None), (1, None)):
        rows = [(k, source, "x", None, "t") for k in range(n)]
        assert checked(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == plain_tree(rows)
    assert checked(spark.createDataFrame([], DOCS)) == []


def test_manifest_query_tells_changed_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op12_merkle_manifest"](spark, SF_DIR).collect()
    assert len(got) == len(docs) and {r.verified for r in got} == {True, False}
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (docs[r.doc_id].text or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


NOTES = [
    "GNU GNU General Public License, Apache License (cc by) CC-BY mit-license", "gnu general public licenses; smith license; mit licensés", "mit\x00license　mit license", "CC BY CC BY cc by",
    "Gnu Lesser General Public License and the GNU General Public License", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "SPDX-License-Identifier:\nMIT",
]


def test_license_scan(spark, docs):
    frame = docs.select("doc_id", "text", "labels").union(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(NOTES)], "doc_id long, text string, labels int"))
    got = licences.scanned(frame).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(got) == sorted(((r.doc_id, *plain_base(r.text)) for r in frame.collect()), key=repr)
    assert licences.scanned(spark.createDataFrame([], DOCS)).collect() == []
    for r in licences.scanned(frame).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_license_scan_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op13_license_scan"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert tuple(r)[1:6] == plain_base(docs[r.doc_id])


def test_expressions():
    def said(text):
        return sorted(sorted(choice) for choice in licences.evaluate(licences.tokens(text)))

    assert said("mit or apache-2.0 and gpl-2.0 with x") == [["apache-2.0", "gpl-2.0 with x"], ["mit"]]
    assert said("(mit or apache-2.0) and isc */ rest") == [["apache-2.0", "isc"], ["isc", "mit"]]
    assert said("((mit)) words") == said("mit and or") == said("mit\nor isc") == [["mit"]]
    assert said("mit or mit and mit") == [["mit"]]
    for bad in ("", "(mit", "()", "and mit", "(mit or isc) with x", "mit with (x and y)"):
        with pytest.raises(licences.Malformed):
            licences.evaluate(licences.tokens(bad))
    wide = " and ".join(f"(a{i} or b{i})" for i in range(40))
    assert set().union(*licences.evaluate(licences.tokens(wide))) == {f"{c}{i}" for c in "ab" for i in range(40)}
    assert [licences.label_of(x) for x in ("gpl-2.0-or-later", "gplv3", "mit", "mitre", "lgpl-3.0", "0bsd", "bsd-3-clause", "foo")] == ["gpl", None, "mit", None, "lgpl", "bsd", "bsd", None]
    scan = licences.scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */")
    assert scan.labels == {"mit", "apache", "gpl"} and scan.base_labels == set() and len(scan.expressions) == 1 and scan.score == pytest.approx(0.95)
    assert licences.scan("SPDX-License-Identifier: proprietary").score == 0
