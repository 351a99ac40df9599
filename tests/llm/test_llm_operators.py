"""Each operator of winfleet.llm against a plain version of what it promises, on small tables with awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from winfleet.llm import embedding_dedup, fingerprints, html_density, language_id, mixing, order_minhash, packing, recompression, token_output, warc
from winfleet.llm.common import components
from winfleet.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark int, digest int"


def vocabulary(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Prose, copies, near copies, shared passages, one long text, runs of one word, and texts without words."""
    rng = np.random.default_rng(5)
    words = vocabulary(rng, 400)
    prose = lambda n: list(rng.choice(words, n))
    passage = prose(40)
    out = [" ".join(prose(int(rng.integers(1, 150)))) for _ in range(40)]
    for k in range(12):
        base = out[k].split()
        base[len(base) // 2] = "changed"
        out += [out[k], " ".join(base), " ".join(prose(30) + passage + prose(20)), " ".join(passage[: 10 + k])]
    out += ["same " * 60, "same " * 30 + "other", "a b " * 40, " ".join(prose(6000)), "", None, " \n\t ", "één woord　hier " * 20, "x" * 50_000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    order = np.random.default_rng(1).permutation(len(texts)).tolist()
    rows = [(i * 3, texts[k], ("en", "de", None)[i % 3], (None, "a", "B", "hot", "hot", "hot")[i % 6], len(texts[k] or ""), 1, 2) for i, k in enumerate(order)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(frame, key=0):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[key] is not None, r[key] or 0))


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"), "test")))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7, 5: 5} | {100 + i: 100 for i in range(31)}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    near = base[:20] + rng.normal(size=(20, 24)) * 0.25
    copies = np.concatenate([base[:5]] * 3)
    vectors = np.concatenate([base, near, copies, base[3:4] * 7]).astype(np.float32).tolist()
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, "x") for i, v in enumerate(vectors + odd)]
    got = rows_of(embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string"), block_rows=16))
    links = collections.defaultdict(set)
    for i, a, _ in rows:
        for j, b, _ in rows:
            if i != j and a and b and len(a) == len(b) and None not in a and None not in b:
                x, y = np.array(a, dtype=float), np.array(b, dtype=float)
                with np.errstate(all="ignore"):
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                        links[i].add(j)
    root = united(len(rows), [(a, b) for a in links for b in links[a]])
    assert got == [(i, len(links[i]), root[i], root[i] == i) for i in range(len(rows))]
    assert sum(n for _, n, _, _ in got) > 60
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_vectors_without_id(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.01]), (None, [0.0, 1.0])]
    got = rows_of(embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sorted(got, key=repr) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)], key=repr)


def test_rank_codes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_output.encode_ranks(values)
        assert (token_output.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def test_token_files(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>b c\nd", "<|endoftext|", "a  b", " a", "a\n\nb", "don't 's\n12 34$%", "a\x85 b", "x\x1cy z", "it's a\n'tis\nend "]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (30, "twice"), (30, "twice")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    blocks, folder = token_output.write_ids(both, path, 2, block_tokens=500)
    got = token_output.read_ids(spark, blocks, folder).collect()
    wanted = collections.Counter((r.doc_id, np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for r in both.collect())
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == wanted
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens == len(r.ids) // 4 for r in got)
    assert token_output.PieceCache(path).encode(["a <|endoftext|> b"]) == [np.array([64, 220, 50256, 275], dtype="<u4").tobytes()]
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    blocks, folder = token_output.write_ids(nothing, path, 2)
    assert token_output.read_ids(spark, blocks, folder).collect() == []


def test_new_words_share_what_is_known_of_their_letters(monkeypatch):
    """Words that differ in their punctuation alone were each encoded anew; ids stay those of whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    cache, learned = token_output.PieceCache(path), []
    learn = cache.learn
    monkeypatch.setattr(cache, "learn", lambda words, *more: (learned.extend(words), learn(words, *more)))
    rng = np.random.default_rng(8)
    letters = ["zuäbe", "oneahaes", "it's", "a1", "\u00b2x\u00bd", "\u4e2d\u6587", "x\u0345", "\u0378", "'s", "don't", "\u00adq", "-", "\u00e9\u0301"]
    ends = ["", ".", ",", "!!", "'", "'.", "\u2019", "%%%", "...'s", "_"]
    words = [a + b + c for a in letters for b in ends for c in ("", ".", "é")]
    texts = [" ".join(rng.permutation(words).tolist()) + "\n" + " ".join(rng.permutation(words).tolist()) for _ in range(30)]
    wanted = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert cache.encode(texts[:10]) + cache.encode(texts[10:]) == wanted
    assert learned.count("zuäbe") == learned.count("oneahaes") == learned.count("it's") == 1
    assert not {"zuäbe.", "oneahaes!!", "it's%%%", "a1'."} & set(learned)
    assert len(learned) == len(set(learned))


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    """Every place of a word was looked up by Python; ids stay those of whole texts, odd ones among them."""
    import public_tokenizers

    path, end = public_tokenizers.path("byte_bpe_50k.json"), np.array([2], dtype="<u4").tobytes()
    cache, looked = token_output.PieceCache(path, limit=40), []
    values = cache.values
    monkeypatch.setattr(cache, "values", lambda words: (looked.append(words), values(words))[1])
    rng = np.random.default_rng(11)
    words = ["the", "zuäbe", "é", "1a", "don't", "'s", "-", "x\u0345", "\u0535", "\u4e2d", "\u0120", "\u010a", "\U0001f600", "\u200b", "\x00"]
    words = [w + e for w in words for e in ("", ".", ",", "!'", "\u2019")]
    texts = ["".join(w + s for w, s in zip(rng.choice(words, 60), rng.choice([" ", " ", "\n"], 60)))[:-1] for _ in range(200)]
    odd = ["", " ", "\n", "a ", " a", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "a\u00a0b", "a\tb", "a\x1cb", "a\u3000b", "a <|endoftext|> b", "x" * 1000, "a"]
    texts = [t for pair in zip(texts, odd * 12) for t in pair]
    wanted = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for t in texts]
    assert cache.encode_array(pa.array(["left out", *texts]).slice(1), end).to_pylist() == wanted
    assert len(looked) == 1 and len(looked[0]) == len(set(looked[0])) < 2 * len(words) + 4
    assert not {"the.", "zuäbe,", "\né!'", "1a,"} & set(looked[0])
    assert cache.encode_array(pa.array(texts[:50]), end).to_pylist() == wanted[:50]
    assert cache.encode_array(pa.array([], pa.string())).to_pylist() == []


def test_packing(docs, nothing):
    got = packing.best_fit(docs.union(docs.limit(3)), lengths=(64, 128, 256), group_pieces=40).collect()
    sizes = collections.Counter()
    for r in docs.union(docs.limit(3)).collect():
        sizes[r.doc_id] += len(WORD.findall(r.text or ""))
    taken = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        taken[r.doc_id] += r.piece_words
        bins[r.bin_id].append(r)
    assert taken == +sizes
    for own in bins.values():
        place = 0
        for r in sorted(own, key=lambda r: r.bin_start):
            assert r.bin_start == place
            place += r.piece_words
        assert {r.bin_words for r in own} == {place}
        assert {r.bin_length for r in own} == {min(c for c in (64, 128, 256) if c >= place)}
    assert sum(taken.values()) / sum(own[0].bin_length for own in bins.values()) > 0.9
    assert packing.best_fit(nothing).collect() == []


def test_packing_follows_from_the_rows(spark, docs, rows_of):
    """Not from their partitions, and repeated rows are spread over groups."""
    rows = docs.select("doc_id", "text").union(spark.range(500).selectExpr("7L AS doc_id", "'one row many times over' AS text"))
    first = rows_of(packing.best_fit(rows, lengths=(64, 128), group_pieces=40))
    again = rows_of(packing.best_fit(rows.repartition(7, "text").union(rows.limit(0)), lengths=(64, 128), group_pieces=40))
    assert first == again
    copies = [r for r in first if r[0] == 7 and r[3] == 5]
    assert len(copies) >= 500 and len({r[4].split("-")[0] for r in copies}) > 5


def plain_pack(sizes, lengths, overhead):
    """Best fit by looking at every open bin."""
    bins, out = [], []
    for i, size in enumerate(sizes):
        open_bins = [(room, -born, b) for b, (room, born, _) in enumerate(bins) if room >= size and room]
        if open_bins:
            b = min(open_bins)[2]
        else:
            rest = sum(sizes[i:])
            cost = {c: (overhead + c) / min(c, rest) for c in lengths if c >= size}
            b = len(bins)
            bins.append([min(cost, key=lambda c: (cost[c], c)), 0, 0])
        out.append((b, bins[b][2]))
        bins[b] = [bins[b][0] - size, i, bins[b][2] + size]
    return [(b, place, min(c for c in lengths if c >= bins[b][2])) for b, place in out]


@pytest.mark.parametrize("seed", range(8))
def test_packing_agrees_with_a_plain_version(seed):
    source = np.random.default_rng(seed)
    sizes = sorted(source.integers(1, 257, 300).tolist(), reverse=True)
    bins, places, final = packing.pack(np.array(sizes), (64, 128, 256), 16.0)
    assert list(zip(bins.tolist(), places.tolist(), final.tolist())) == plain_pack(sizes, (64, 128, 256), 16.0)


def test_packing_opens_the_cheapest_bin():
    bins, places, final = packing.pack(np.array([100, 60, 56, 40]), (128, 256), overhead=64)  # (64 + 256) / 256 beats (64 + 128) / 128
    assert bins.tolist() == [0, 0, 0, 0] and places.tolist() == [0, 100, 160, 216] and set(final) == {256}
    assert set(packing.pack(np.array([100]), (128, 256), overhead=64)[2]) == {128}


def test_fingerprints(spark, docs, nothing):
    got = rows_of(fingerprints.compared(docs))
    wanted = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert [r[0] for r in got] == [d for d, _ in wanted]
    digests = lambda t: collections.Counter(fingerprints.paragraphs(t))

    def likeness(a, b):
        a, b = digests(a), digests(b)
        both = sum(a.values()) + sum(b.values())
        return 1 - sum(((a - b) + (b - a)).values()) / both if both else 1.0

    seen = {}
    for row, (_, text), (_, following) in zip(got, wanted, wanted[1:] + wanted[:1]):
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        assert row[1] == len(text)
        assert row[2] == hashlib.sha256(changed.encode()).hexdigest()
        assert row[5] == pytest.approx(likeness(text, changed)) and row[6] == pytest.approx(likeness(text, following))
        assert seen.setdefault(text, row[3]) == row[3]
        assert seen.setdefault(changed, row[4]) == row[4]
    assert fingerprints.compared(nothing).collect() == []
    assert len(fingerprints.compared(spark.createDataFrame([(1, "a. b. c.")], "doc_id long, text string")).collect()) == 1


def test_sketches_grow_until_they_peel():
    rng = np.random.default_rng(6)
    pools = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 3, 50, 700)]
    left, right = [], []
    for pool in pools:
        for gone in (0, len(pool) // 3, len(pool)):
            left.append(pool)
            right.append(np.concatenate([pool[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
    assert fingerprints.differences(left, right).tolist() == [len(np.setxor1d(a, b)) for a, b in zip(left, right)]


def test_near_documents(docs, nothing, texts):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    pieces = []
    for _, text in rows:
        words = WORD.findall(text or "")
        pieces.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = []
    for j in range(len(rows)):
        for i in range(j):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (pieces[i] and pieces[j] and len(pieces[i] & pieces[j]) / len(pieces[i] | pieces[j]) >= 0.8):
                pairs.append((i, j))
    root = united(len(rows), pairs)
    got = rows_of(order_minhash.near_documents(docs, block_docs=4).select("doc_id", "class_id", "kept"))
    assert got == [(d, rows[k][0], rows[k][0] == d) for (d, _), k in zip(rows, root)]
    assert len(pairs) > 15
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, c, _ in got if d == c]
    assert order_minhash.near_documents(nothing).collect() == []


def test_near_documents_in_chains_and_large_groups(spark):
    """Links between neighbours of a chain only, and many near copies of one text: tiles must not lose a link between blocks."""
    rng = np.random.default_rng(21)
    words = vocabulary(rng, 3000)
    chain, copies = list(rng.choice(words, 150)), list(rng.choice(words, 150))
    out = []
    for k in range(30):
        chain = chain.copy()
        chain[(5 + 17 * k) % 150] = f"new{k}"
        chain[(80 + 17 * k) % 150] = f"newer{k}"
        out.append(" ".join(chain))
    for k in range(30):
        near = copies.copy()
        near[5 + 4 * k] = f"own{k}"
        near[149 - 4 * k] = f"other{k}"
        out.append(" ".join(near))
    order = rng.permutation(len(out)).tolist()
    rows = [(i, out[k]) for i, k in enumerate(order)]
    sets = []
    for _, text in rows:
        t = text.split()
        sets.append({tuple(t[i : i + 5]) for i in range(len(t) - 4)})
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    root = united(len(rows), pairs)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(order_minhash.near_documents(frame, block_docs=4).select("doc_id", "class_id"))
    assert got == [(i, root[i]) for i in range(len(rows))]
    assert 2 <= len(set(root)) < 20


def test_near_copies_of_few_words(spark):
    """Texts of 8 to 15 words and the same with one word more: 4 against 5 shingles and up, all 0.8 similar or more."""
    words = vocabulary(np.random.default_rng(31), 2000)
    rows, want = [], []
    for k in range(400):
        text = [words[(17 * k + 7 * j) % 2000] + str(k) for j in range(8 + k % 8)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + ["more"]))]
        want += [(2 * k, 2 * k), (2 * k + 1, 2 * k)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(order_minhash.near_documents(frame).select("doc_id", "class_id")) == want


def test_texts_that_differ_in_repeats_only(spark):
    words = vocabulary(np.random.default_rng(32), 3000)
    rows, want = [], []
    for k in range(10):
        text = [w + str(k) for w in words[200 * k : 200 * k + 204]]
        rows += [(2 * k, " ".join(text * 5)), (2 * k + 1, " ".join(text))]
        want += [(2 * k, 2 * k), (2 * k + 1, 2 * k)]
    assert rows_of(order_minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id")) == want


def test_rearranged_text_is_no_near_copy():
    rng = np.random.default_rng(8)
    names = rng.integers(0, 2**63, 200, dtype=np.uint64)
    assert order_minhash.aligned(names, np.roll(names, 100), 0.8) < 0.8  # all of its shingles, in another order
    assert order_minhash.aligned(names, np.delete(names, [5, 80]), 0.8) == pytest.approx(0.99)


def test_archives(spark):
    magic = warc.record(7, "http://inside/", b"trick", None).decode()
    html = ["<p>one</p>", "<p>one</p>", "", None, magic, magic + "x", "WARC/1.1\r\nContent-Length: 99\r\n\r\n", "é" * 3000, "big" * 40_000, "<p>one</p>"]
    rows = [(i if i != 6 else None, f"http://x/{i}\r\ny", h, "extra") for i, h in enumerate(html)] * 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response string").repartition(3)
    files = warc.write_archives(pages, file_bytes=60_000)
    got = {r.page_id: r for r in warc.read_archives(spark, files, stretch_bytes=1000, with_payload=True).collect()}
    assert len(got) == len(html)
    for page_id, _, text, _ in rows:
        payload = (text or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (text or "")]
        last = max((p for p in same if p is not None), default=None)
        row = got[page_id]
        assert (row.payload_bytes, row.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (row.record_type, row.refers_to) == (("response", None) if page_id == last else ("revisit", last))
        assert bytes(row.payload) == (payload if page_id == last or last is None else b"")
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, empty).collect() == []
    short = warc.read_archives(spark, warc.write_archives(pages.where("html = '<p>one</p>'"), min_bytes=100)).collect()
    assert {r.record_type for r in short} == {"response"}


@pytest.mark.parametrize("place", [0, 30])
def test_archives_with_long_headers(spark, place):
    """Headers over 64 KB at the start of a file and in a later stretch; a payload full of record starts stays a payload."""
    urls = [f"http://x/{i}" for i in range(40)]
    urls[place] = "data:text/plain," + "a" * 200_000
    pages = spark.createDataFrame([(i, u, "WARC/1.1\r\n" * 3000 + str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages)
    got = {r.page_id: (r.url, r.payload_bytes) for r in warc.read_archives(spark, files, stretch_bytes=100_000).collect()}
    assert got == {i: (u, 30_000 + len(str(i))) for i, u in enumerate(urls)}


@pytest.mark.parametrize("cut", [5, 200, 41_000])
def test_broken_archive_fails(spark, tmp_path, cut):
    whole = b"".join(warc.record(i, "http://x/", b"p" * 2000 * i, None) for i in range(1, 9)) + warc.record(9, "u", b"", warc.record_id(1))
    path = tmp_path / "broken.warc"
    path.write_bytes(whole[:-cut])
    files = spark.createDataFrame([(f"file://{path}", len(whole) - cut)], "path string, n_bytes long")
    with pytest.raises(ValueError, match="do not lead to its end"):
        warc.read_archives(spark, files, stretch_bytes=10_000).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu<li><a href=y>More</a></ul></nav><div class="cookie-notice">We use cookies.</div>
{main}<div class="comments"><p>First! I disagree with all of it and say so at some length here.</p></div><form><p>Name <input></p></form>
<div class="sidebar"><p>Other things to read.</p></div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div id=story><div>{}</div></div>"])
def test_main_text(spark, shell):
    inner = "<h1>A title &amp; more</h1><p><b>Lead in\n bold<p>Second&nbsp;paragraph <a href=z>with link</a>, and words enough to count.</p><!-- note --><ul><li>one<li>two</ul><p>Last &lt;tag&gt; &#233;.</p>"
    want = "A title & more\nLead in bold\nSecond paragraph with link, and words enough to count.\none\ntwo\nLast <tag> é."
    pages = [(1, "u", PAGE.format(main=shell.format(inner)), 0), (2, None, None, 0), (None, "v", "", 0), (4, "w", "just text", 0), (5, "x", "<div>" * 3000 + "deep" + "</div>" * 3000, 0)]
    got = {r.page_id: r for r in html_density.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert (got[2].text, got[None].text, got[4].text, got[5].text) == ("", "", "just text", "deep")


def test_article_of_any_length_is_kept_whole():
    for text in ("x", "One. " * 3, "word " * 30_000):
        assert html_density.extract(PAGE.format(main=f"<article><p>{text}</p></article>")) == text.strip()


@pytest.mark.parametrize("name", ["category-football", "navy", "footage", "post-footnotes", "menu"])
def test_names_that_only_look_like_noise_keep_their_text(name):
    text = "Words of the story that stand in a named element and make up nearly all of this page. " * 8
    page = f"<html><body><div class='navbar'>Menu</div><div class='{name}'><p>{text}</p></div><div id=footer>Us</div></body></html>"
    assert html_density.extract(page) == text.strip()
    page = f"<article><p>{text}</p><div class='footnotes'><p>1. A note.</p></div><div class='footer'>Us</div></article>"
    assert html_density.extract(page) == text.strip() + "\n1. A note."


def test_every_article_and_section_of_the_text_stays():
    text = "Words enough to count as a paragraph of a story that goes on for a while. " * 4
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>One</h1><p>{text}</p></article><article><h1>Two</h1><p>{text}</p></article></body>"
    assert html_density.extract(page) == "\n".join(["One", text.strip(), "Two", text.strip()])
    links = "<a href=x>More of this</a> <a href=y>More of that</a>"
    for name in ("related-work", "share", "social-history"):
        page = f"<body><article><h1>One</h1><p>{text}</p><div class='{name}'><p>{text}</p></div></article></body>"
        assert html_density.extract(page) == "\n".join(["One", text.strip(), text.strip()])
        assert html_density.extract(f"<body><article><p>{text}</p><div class='{name}'>{links}</div></article></body>") == text.strip()


def test_the_article_tag_decides_nothing():
    for row in pq.read_table(f"{TESTDATA}/sf0.01/pages.parquet").to_pylist():
        renamed = re.sub(r"(</?)article\b", r"\1div", row["html"])
        assert html_density.extract(renamed) == html_density.extract(row["html"])


def plain_main_nodes(root):
    """The density rule with every sum taken anew over the whole subtree."""
    shown = lambda n: [p for p in n.parts if not isinstance(p, str) and not p.noise]
    under = lambda n: [d for p in shown(n) for d in (p, *under(p))]
    every = [root, *under(root)]
    chars = lambda n: sum(len(p.strip()) for m in (n, *under(n)) for p in m.parts if isinstance(p, str))

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(map(link_chars, shown(n)))

    body = next((n for n in every if n.tag == "body"), root)
    ratio = link_chars(body) / chars(body) if chars(body) else 0.0

    def density(n):
        c, lc, t, lt = chars(n), link_chars(n), len(under(n)), sum(m.tag == "a" for m in under(n))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base

    total = lambda n: sum(density(p) for p in shown(n) if p.tag in html_density.CONTAINERS)
    full = [n for n in every if chars(n)]
    if not full:
        return []
    heart = max(full, key=total)
    path = [n for n in every if n is heart or any(m is heart for m in under(n))]
    path = path[path.index(body) :] if body in path else path
    least = min(map(density, path))
    best = lambda n: max([n, *(best(p) for p in shown(n) if chars(p))], key=total)
    marked = {id(best(n)) for n in full if density(n) >= least and n is not body}

    def top(n):
        return [n] if id(n) in marked else [m for p in shown(n) for m in top(p)]

    return top(body) or [heart]


def test_density_rule_equals_its_plain_version():
    rng = random.Random(8)

    def piece(depth):
        tag = rng.choice(["div", "p", "section", "ul", "span", "b", "a", "article", "div class=menu", "div class=share", "li"])
        inside = "".join(piece(depth - 1) if depth and rng.random() < 0.6 else "word " * rng.randrange(12) for _ in range(rng.randrange(4)))
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    for _ in range(150):
        page = "<body>" + "".join(piece(3) for _ in range(rng.randrange(1, 4))) + "</body>"
        tree = html_density.parse(page)
        wanted = [id(n) for n in plain_main_nodes(tree)]
        assert [id(n) for n in html_density.main_nodes(tree)] == wanted


@pytest.mark.parametrize(
    "page",
    ['<a b="' * 170_000, "<a b='\"" * 120_000, "<div>" * 30_000 + "</x>" * 200_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 150_000, "<ul>" + "<div>" * 50_000 + "<li></li>" * 30_000, "<i>" * 50_000 + "<hr>" * 50_000, "<a" * 500_000, "<!" * 500_000, "<!--" * 250_000, "<script>" + "</script " * 100_000],
    ids=range(10),
)
def test_odd_markup_takes_linear_time(page):
    start = time.process_time()
    html_density.extract(page)
    assert time.process_time() - start < 5


def test_repeats(docs, nothing):
    rows = sorted((r.doc_id, WORD.findall(r.text or "")) for r in docs.collect())
    first = {}
    for d, words in rows:
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), d)
    wanted = []
    for d, words in rows:
        gone = {k for i in range(len(words) - 12) if first[tuple(words[i : i + 13])] < d for k in range(i, i + 13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        wanted.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = recompression.without_repeats(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert rows_of(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == wanted
    assert sum(w[2] for w in wanted) > 1000
    assert recompression.without_repeats(nothing).collect() == []


def test_hot_passages_are_dealt_to_many_tasks(docs, monkeypatch):
    columns = ("doc_id", "n_removed", "kept_sha256")
    wanted = rows_of(recompression.without_repeats(docs).select(*columns))
    monkeypatch.setattr(recompression, "HOT", 2)
    assert rows_of(recompression.without_repeats(docs).select(*columns)) == wanted


def test_words_have_two_independent_names():
    words = split_words(pa.array(["a b a", None, "", "b c"]), twice=True)
    assert words.hashes[0] == words.hashes[2] and words.seconds[0] == words.seconds[2] and words.seconds[1] == words.seconds[3]
    assert len(set(words.hashes.tolist()) | set(words.seconds.tolist())) == 6
    assert len(split_words(pa.array([None, " "], pa.string()), twice=True).seconds) == 0


def test_rows_without_id_neither_give_nor_lose_words(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = recompression.without_repeats(spark.createDataFrame([(None, text), (2, text), (2, text), (3, text + " more")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (2, 0), (2, 0), (3, 20)]


def test_languages(spark, nothing):
    rng = np.random.default_rng(4)
    parts = {"aa": ["lo", "mi", "ta", "re"], "bb": ["sch", "ung", "öch", "tz"], "cc": ["ción", "os", "que", "ra"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(30)), lang if i % 7 else None) for i, lang in enumerate(list(parts) * 60)]
    rows += [(900, None, "aa"), (901, "12 !? 34", "bb"), (902, "", "cc"), (None, "lomi tare", "aa")]
    got = rows_of(language_id.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))))
    truth = {i: list(parts)[i % 3] for i in range(180)}
    assert all(r[2] == truth[r[0]] for r in got if r[0] in truth)
    assert [r[2:] for r in got if r[0] in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in got if r[0] is not None)
    assert all(0 <= r[3] <= 1 for r in got)
    assert language_id.language_of(nothing).collect() == []


def test_languages_of_one_script_outside_latin(spark):
    """Letters six code points apart: one language is the other's texts with each letter moved on."""
    rng = np.random.default_rng(14)
    vowel, rest = [chr(0x430 + k) for k in (0, 5)], [chr(0x430 + k) for k in (1, 2, 3, 4, 7, 8, 9)]
    words = ["".join(rng.choice(x) for x in (rest, vowel, rest, vowel)) for _ in range(40)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, 12))
        rows.append((i, text if i % 2 else "".join(chr(ord(c) + 6) if c != " " else c for c in text), ("ru", "uk")[i % 2]))
    got = rows_of(language_id.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [r[2] for r in got] == [lang for _, _, lang in rows]
    marks = [language_id.trigrams_of(t).tolist() for t in ("\u0915\u093f\u0924", "\u0915\u0940\u0924", "\u0915 \u0924")]  # vowel signs of Devanagari
    assert marks[0] != marks[1] and marks[0] != marks[2] and len(language_id.trigrams_of("\u0301\u093f")) == 0


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    import corpus_pipeline
    from conftest import TESTDATA

    rng = np.random.default_rng(15)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    prose = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select(corpus_pipeline.COLUMNS)
    noise = ["".join(rng.choice(letters + [" "] * 4, 400)) for _ in range(10)] + ["".join(rng.choice(list("asdfghjkl"), 300)) for _ in range(10)]
    noise += [base64.b64encode(rng.bytes(600)).decode() for _ in range(10)] + ["\u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u044f\u0437\u044b\u043a\u0435 " * 20]
    short = [" ".join(r.text.split()[:3]) for r in prose.where("lang = 'en' AND n_chars > 500").orderBy("doc_id").limit(40).collect()]
    more = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(noise)] + [(2 * 10**6 + i, t, None, "x", len(t)) for i, t in enumerate(short)]
    more = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    unlearned = prose.where("lang = 'de'").withColumn("doc_id", F.col("doc_id") + 3 * 10**6).withColumn("lang", F.lit(None).cast("string"))
    learned = prose.where("lang <> 'de'")
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, learned.union(more).union(unlearned), "").select("doc_id").collect()}
    assert kept >= {r.doc_id for r in learned.select("doc_id").collect()} | {2 * 10**6 + i for i in range(len(short))}
    assert not any(10**6 <= d < 2 * 10**6 for d in kept)
    long = {r.doc_id for r in unlearned.where("n_chars > 400").collect()}
    assert len(long) > 50 and len(long & kept) <= 0.05 * len(long)


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: weight[s] for s in names if s not in full}
        left = total - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s in rest if share[s] > cap * sizes[s]}
        if not over:
            return share | full
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(docs, nothing):
    got = mixing.mixed(docs, group_rows=8).collect()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += words[r.doc_id]
    want = targets_by_hand(sizes)
    taken = collections.Counter()
    for r in got:
        assert (r.size, r.source_size) == (words[r.doc_id], sizes[r.source])
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(words)
    biggest = max(words.values())
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes)
    assert sorted((r.doc_id, r.taken) for r in mixing.mixed(docs, group_rows=8).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mixed(nothing).collect() == []


def test_multipliers_solve_the_dual_over_documents(spark, docs):
    """Bisection on each source's sum of size * min(cap, exp(multiplier * size)) over its documents."""
    got = mixing.mixed(docs, group_rows=8).collect()
    own = collections.defaultdict(list)
    for r in got:
        own[r.source].append(r.size)
    want = targets_by_hand({s: sum(v) for s, v in own.items()})
    rates = {}
    for source, sizes in own.items():
        x = np.array([s for s in sizes if s], dtype=float)
        low, high = -50.0 / x.min(), 2.0 / x.min()
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (x * np.minimum(3, np.exp(np.minimum(middle * x, 50)))).sum() < want[source] else (low, middle)
        rates[source] = low
    assert len({r.rate for r in got if r.source == "hot"}) > 5  # documents of one source differ
    for r in got:
        wanted = min(3.0, np.exp(rates[r.source] * r.size)) if r.size else 0.0
        assert r.rate == pytest.approx(wanted, rel=1e-4)
    for source in own:
        assert sum(r.rate * r.size for r in got if r.source == source) == pytest.approx(want[source], rel=1e-6)


def test_rows_that_repeat_are_mixed_as_one_and_spelled_out_again(spark):
    rows = [(7, "one two three", "hot")] * 5000 + [(None, "four five", None)] * 700 + [(i, "word " * (1 + i % 50), "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mixed(docs, group_rows=100).collect()
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((d, s) for d, _, s in rows)
    for source in ("hot", None, "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50 * 4
        assert max(r.taken - 3 * r.size for r in own) <= 0
    assert len({r.copies for r in got if r.source == "hot"}) <= 2


def test_rounding_follows_the_rate():
    sizes = np.sort(np.random.default_rng(0).integers(1, 5000, 2000))[::-1].astype(float)
    for rate in (0.0, 0.3, 1.0, 1.7, 3.0):
        copies = mixing.rounded_copies(sizes, np.full(len(sizes), rate))
        assert abs((copies * sizes).sum() - rate * sizes.sum()) <= sizes.max() / 2
        assert copies.max(initial=0) <= np.ceil(rate)
