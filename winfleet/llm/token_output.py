"""Token ids of whole documents in files of frequency-ranked, byte-aligned codes, and their way back.

Ids are replaced by their rank (0 for the most frequent), and a rank takes one to four little-endian bytes. The lengths stand
apart, in control bytes that hold four of them with two bits each. A file is a sequence of blocks::

    magic "RNK1", n_docs, n_tokens, n_data (int64), doc ids (int64), null flags (uint8), token counts (int64), control bytes, data bytes

All numbers are little-endian. The ranks are a table of the vocabulary's size, kept beside the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from winfleet.llm.common import new_file, text_slices, written
from winfleet.session import shared_dir

MAGIC = b"RNK1"
HEADER = np.dtype([("magic", "S4"), ("docs", "<i8"), ("tokens", "<i8"), ("data", "<i8")])
#: Bytes of each of the four codes of a control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: How the vocabulary writes a space, a line feed, and other bytes that are no printable ASCII.
SPACE, LINE_FEED = "\u0120", "\u010a"
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {byte: chr(0x100 + k) for k, byte in enumerate(b for b in range(256) if b not in _PRINTED)}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below this character, every version of Unicode agrees on what a letter is.
STABLE = "\u0530"
#: How the vocabulary writes letters below it; a space stays, and the space of the next word follows it.
WRITTEN = ["".join(BYTES.get(byte, chr(byte)) for byte in chr(c).encode()) for c in range(ord(STABLE))]
WRITTEN[0x20] = " " + SPACE
#: Letters and digits below it, by code point, as far as two bytes with the same lead go.
ALNUM = np.array([c < ord(STABLE) and chr(c).isalnum() for c in range(0x540)])


#: Texts that are no words with one space or line feed between them.
_OTHER_SPACE = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
ODD_SPACE = rf"^[ \n]|[ \n][ \n]|[ \n]$|^$|[{_OTHER_SPACE}]"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative integers below 2**32."""
    ranks = ranks.astype("<u4")
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        codes[: len(ranks)] += ranks > most
    widest = 1 + int(codes.max(initial=0))
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :widest][np.arange(widest, dtype=np.uint8) <= codes[: len(ranks), None]]
    return (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The integers again: the table gives the lengths, their sums the places in the data."""
    sizes = LENGTHS[control].ravel()[:count]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[at].astype(np.uint32) if count else np.zeros(0, dtype=np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        if len(longer) == 0:
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class PieceCache:
    """Ids of words as bytes of ``id_type``, with a space or a line feed before them.

    A byte-level vocabulary of this kind starts a new token at a space that has no white space beside it, and takes a lone line
    feed by itself. So texts whose only white space is of these two sorts may be put together from the ids of their words;
    others are encoded whole, as are texts that hold the string of a token added to the vocabulary. A word that ends in ASCII
    punctuation after a letter or digit is put together from the two, as the vocabulary cuts there; one of letters alone is a
    single piece, so the vocabulary's merges are applied to its bytes without the search for pieces. Entries are kept in two
    generations of ``limit`` words, which bounds the memory.

    Arrow finds the different words of many texts, cuts off their punctuation and takes the ids to all places of a word, so Python
    looks up each sequence of letters once a call.
    """

    def __init__(self, path: str, limit: int = 300_000, id_type: str = "<u4"):
        self.tokenizer, self.limit, self.id_type = _tokenizer(path), limit, np.dtype(id_type)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.young: dict[str, bytes] = {}  # words after a space, by the word, and after a line feed, by both
        self.old: dict[str, bytes] = {}
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaces, self.line_feeds = np.zeros((2, max(vocabulary.values()) + 1), dtype=bool)  # whether a token starts so, by its id
        for token, i in vocabulary.items():
            self.spaces[i], self.line_feeds[i] = token.startswith(SPACE), token.startswith(LINE_FEED)
        self.first: dict[str, bytes] = {}  # punctuation at the end of words
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.id_type).tobytes()

    def add(self, words: list[str]) -> None:
        """Learn words after a space, or after the line feed that they begin with."""
        starts, plain, others = [], [], []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or max(w) < STABLE) else starts if w[0] == "\n" else others).append(w)
        self.learn(plain, self.pieces, self.spaces, lambda part: SPACE + " ".join(part).translate(WRITTEN))
        self.learn(starts, self.tokenizer, self.line_feeds, "".join)
        self.learn(others, self.tokenizer, self.spaces, lambda part: " " + " ".join(part))

    def learn(self, words: list[str], tokenizer: Tokenizer, starts: np.ndarray, joined: Callable[[list[str]], str]) -> None:
        """Words are encoded in one string, and cut where a token starts with the space or line feed before them."""
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            ids = np.array(tokenizer.encode_batch_fast([joined(part)], add_special_tokens=False)[0].ids, dtype=self.id_type)
            at = np.flatnonzero(starts[ids])
            if len(at) != len(part):
                self.young.update((w, self.whole(w if w[0] == "\n" else " " + w)) for w in part)
                continue
            raw, cuts = ids.tobytes(), (np.append(at, len(ids)) * self.id_type.itemsize).tolist()
            self.young.update(zip(part, [raw[low:high] for low, high in zip(cuts[:-1], cuts[1:])]))

    def first_of(self, word: str) -> bytes:
        found = self.first.get(word)
        if found is None:
            if len(self.first) > self.limit // 4:
                self.first.clear()
            found = self.first[word] = self.whole(word)
        return found

    def values(self, words: list[str]) -> list[bytes]:
        """Ids of different words: after a line feed, if they begin with one, else after a space."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young if len(self.young) < 2 * self.limit else {}
        out: list[bytes | None] = list(map(self.young.get, words))
        gaps = [k for k, v in enumerate(out) if v is None]
        again = list(map(self.old.get, [words[k] for k in gaps]))
        self.young.update((words[k], v) for k, v in zip(gaps, again) if v is not None)
        self.add([words[k] for k, v in zip(gaps, again) if v is None])
        for k in gaps:
            out[k] = self.young[words[k]]
        return out

    def word_values(self, words: pa.Array) -> pa.Array:
        """Ids of different words, by those of their letters and of their punctuation."""
        heads = pc.ascii_rtrim(words, PUNCTUATION)
        size, left = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, heads))
        low = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        cut = np.flatnonzero((left > 0) & (left < size))
        last, before = raw[low[cut] + left[cut] - 1].astype(np.int64), raw[low[cut] + np.maximum(left[cut], 2) - 2].astype(np.int64)
        point = np.where(last < 0x80, last, np.where((before >= 0xC2) & (before <= 0xD4), (before & 0x1F) << 6 | last & 0x3F, 0))
        cut = cut[ALNUM[point]]
        is_cut = np.zeros(len(words), dtype=bool)
        is_cut[cut] = True
        long = size - left
        ends = np.cumsum(long[cut])
        at = np.repeat(low[cut] + left[cut] - ends + long[cut], long[cut]) + np.arange(long[cut].sum())
        tails = pa.Array.from_buffers(pa.large_string(), len(cut), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(raw[at])]).dictionary_encode()
        heads = pc.if_else(pa.array(is_cut), heads, words).dictionary_encode()
        kinds = [b"", *map(self.first_of, tails.dictionary.to_pylist())]
        kind = np.zeros(len(words), dtype=np.int64)
        kind[cut] = 1 + tails.indices.to_numpy()
        values = pa.array(self.values(heads.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        return pc.binary_join_element_wise(values.take(heads.indices), pa.array(kinds, pa.large_binary()).take(pa.array(kind)), pa.scalar(b"", pa.large_binary()))

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text, then ``end``."""
        alone = pc.match_substring_regex(texts, ODD_SPACE)
        for token in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, token))
        alone = alone.to_numpy(zero_copy_only=False)
        whole = pa.array([self.whole(text) + end for text in texts.filter(pa.array(alone)).to_pylist()], pa.large_binary())
        rest = self.encode_words(texts.filter(pa.array(~alone)), end)
        return pa.concat_arrays([rest, whole]).take(pa.array(np.where(alone, len(rest) - 1 + np.cumsum(alone), np.cumsum(~alone) - 1)))

    def encode_words(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The same for texts of words with a space or a line feed between them.

        Different words are looked up once, and Arrow takes their ids to all their places.
        """
        if len(texts) == 0:
            return pa.array([], pa.large_binary())
        feed, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        lines = pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n")
        split = pc.split_pattern(pc.binary_join_element_wise(feed, lines, nothing), " ")
        words = split.flatten().dictionary_encode()
        values = self.word_values(words.dictionary)
        place = words.indices.to_numpy().astype(np.int64)
        counts = np.diff(split.offsets.to_numpy())
        firsts = np.cumsum(counts) - counts
        # the first word of a text has no line feed before it, and the end follows the last
        opening = [x[len(self.line_feed) :] for x in values.take(pa.array(place[firsts])).to_pylist()]
        place[firsts] = len(values) + np.arange(len(texts))
        place = np.insert(place, np.cumsum(counts), len(values) + len(texts))
        ids = pa.concat_arrays([values, pa.array([*opening, end], pa.large_binary())]).take(pa.array(place))
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.append(0, np.cumsum(counts + 1))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), data])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string())).to_pylist()


@lru_cache(maxsize=1)
def _cache(path: str, id_type: str) -> PieceCache:
    return PieceCache(path, id_type=id_type)


def encode_texts(texts: pa.Array, path: str, id_type: str, end: bytes = b"") -> pa.Array:
    """Ids of each text and ``end`` as bytes of the type; equal to encoding each whole text. The cache lives as long as the worker."""
    return _cache(path, id_type).encode_array(texts, end)


def narrowest(tokenizer_path: str, end_id: int) -> str:
    """Two bytes for an id if all of them fit, else four."""
    return "<u2" if max(end_id, *_tokenizer(tokenizer_path).get_vocab().values()) < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (bytes of the narrowest type), shard, seq in ascending order of ids: shards by range, seq inside a shard."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    id_type = narrowest(tokenizer_path, end_id)
    end = np.array([end_id], dtype=id_type).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for part in text_slices(batch, "text", 6_000_000):
                ids = encode_texts(part["text"], tokenizer_path, id_type, end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), ids, part["shard"], pa.array(np.arange(seq, seq + len(ids)))], names=["doc_id", "ids", "shard", "seq"])
                seq += len(ids)

    return rows.mapInArrow(encode, "doc_id long, ids binary, shard int, seq long")


def id_counts(staged: DataFrame, id_type: str) -> DataFrame:
    """id, n over all documents; at most a row per id and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = np.bincount(np.frombuffer(b"".join(batch["ids"].slice(k, 512).to_pylist()), dtype=id_type))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return staged.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int = 1 << 20, **columns: str) -> tuple[DataFrame, str]:
    """Encode all documents and write their ids, in ascending order of doc_id, below a new shared folder.

    Returns the list of blocks (shard, seq, path, at, n_bytes, n_docs, n_tokens) and the folder, which also holds ``ranks.npy``.
    Null ids come first; rows of equal id stand beside each other, in an order given by their texts' hashes. A null text has the
    end id alone. An empty table writes no block. Only the counts of the vocabulary's ids come to the driver.
    """
    spark = docs.sparkSession
    staged = written(tokenized(docs, tokenizer_path, end_id, **columns), "token-ids")
    id_type = narrowest(tokenizer_path, end_id)
    width = np.dtype(id_type).itemsize
    counts = id_counts(staged, id_type).orderBy(F.desc("n"), "id").toPandas()
    id_of_rank = counts["id"].to_numpy(dtype=np.int64)
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank))
    folder = shared_dir(spark, "ranked-ids")
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    with filesystem.open_output_stream(f"{path}/ranks.npy") as out:
        out.write(id_of_rank.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, stream, name, place = [], None, "", 0
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal stream, name, place, size
            if not held:
                return
            if stream is None:
                name, system, inner = new_file(folder, ".ids")
                stream = system.open_output_stream(inner)
            ids = np.frombuffer(b"".join(row[1] for row in held), dtype=id_type)
            control, data = encode_ranks(rank_of_id[ids])
            header = np.array([(MAGIC, len(held), len(ids), len(data))], dtype=HEADER)
            block = b"".join([
                header.tobytes(),
                np.array([row[0] or 0 for row in held], dtype="<i8").tobytes(),
                np.array([row[0] is None for row in held], dtype=np.uint8).tobytes(),
                np.array([len(row[1]) // width for row in held], dtype="<i8").tobytes(),
                control,
                data,
            ])
            stream.write(block)
            found.append((held[0][2], held[0][3], name, place, len(block), len(held), len(ids)))
            place += len(block)
            held.clear()
            size = 0

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "shard", "seq"))):
                if held and (row[2] != held[0][2] or row[3] != held[-1][3] + 1 or size + len(row[1]) // width > block_tokens):
                    flush()
                held.append(row)
                size += len(row[1]) // width
        flush()
        if stream is not None:
            stream.close()
        columns = list(zip(*found)) if found else [[] for _ in range(7)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BLOCK_TYPES)], names=BLOCK_NAMES)

    blocks = staged.mapInArrow(write, "shard int, seq long, path string, at long, n_bytes long, n_docs long, n_tokens long")
    return written(blocks, "id-blocks"), folder


BLOCK_NAMES = ["shard", "seq", "path", "at", "n_bytes", "n_docs", "n_tokens"]
BLOCK_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def read_ids(spark: SparkSession, blocks: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless left out, ids, decoded from the files."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_stream(f"{path}/ranks.npy") as stream:
        id_of_rank = np.frombuffer(stream.read(), dtype="<u4")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per range partition
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    places = blocks.join(shards, "shard").withColumn("start", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size, start in zip(*(batch[c].to_pylist() for c in ("path", "at", "n_bytes", "start"))):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as stream:
                    block = stream.read_at(size, at)
                magic, docs, tokens, n_data = np.frombuffer(block, dtype=HEADER, count=1)[0].tolist()
                if magic != MAGIC:
                    raise ValueError(f"no block at {at} in {name}")
                place = HEADER.itemsize
                doc_ids = np.frombuffer(block, "<i8", docs, place)
                nulls = np.frombuffer(block, np.uint8, docs, place + 8 * docs).astype(bool)
                lengths = np.frombuffer(block, "<i8", docs, place + 9 * docs)
                place += 17 * docs
                n_control = -(-tokens // 4)
                control = np.frombuffer(block, np.uint8, n_control, place)
                ids = id_of_rank[decode_ranks(control, np.frombuffer(block, np.uint8, n_data, place + n_control), tokens)].astype("<u4")
                ends = np.cumsum(lengths)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                columns = [pa.array(doc_ids, mask=nulls), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * with_ids)
    return places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "at").mapInArrow(read, schema)
