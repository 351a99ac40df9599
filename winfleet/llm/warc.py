"""WARC archives of pages, written with revisit records and read back by following the chain of record boundaries.

Reading: a task looks at one stretch of a file, takes every place that looks like the start of a record as a candidate, and works
out from its header where the next record would begin. Inside the stretch it follows these links to the first boundary behind it.
From the start of each file, pointer jumping over these links (every round doubles the reach) finds the true entry of every
stretch. Only records that are reached from there are read; whatever looks like a record inside a payload is not.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.llm.common import new_file, written
from winfleet.session import shared_dir

MAGIC = b"WARC/1.1\r\n"
HEAD_BYTES = 1 << 16
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE)
DATE = "2024-01-01T00:00:00Z"
#: Upper half of record ids: with a page number in the lower half, or without one.
NUMBERED, UNNUMBERED = 0x77696E666C6540008000, 0x77696E666C6540008001


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    high = UNNUMBERED if page_id is None else NUMBERED
    return f"<urn:uuid:{uuid.UUID(int=((high & 0xFFFFFFFFFFFFFFFF) << 64) | ((page_id or 0) & 0xFFFFFFFFFFFFFFFF))}>"


def page_number(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 == UNNUMBERED & 0xFFFFFFFFFFFFFFFF:
        return None
    low = value & 0xFFFFFFFFFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """One record. ``refers`` is the record id of the response that a revisit stands for; a revisit carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    target = "".join(c for c in url or "" if c.isprintable())
    lines = [f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers:
        lines += [f"WARC-Refers-To: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload (key), response (page number, null if it has none), and unnumbered for payloads that occur more than once."""
    sizes = pages.select("page_id", F.sha1("payload").alias("key"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    return sizes.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").select("key", "response")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for every page below a new shared folder; returns path and n_bytes of the files.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest id is the response and the others revisit
    it; shorter ones are all responses. Rows that share the largest id are all responses. A null html is an empty payload. A null
    id is smaller than any number; if all equal payloads lack an id, all are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    repeated = written(revisits(rows, min_bytes), "warc-repeats")  # a table, so that its size decides how it is joined
    rows = rows.withColumn("key", F.sha1("payload")).join(repeated, "key", "left").select("page_id", "url", "payload", F.when(~F.expr("page_id <=> response"), F.col("response")).alias("response"))
    folder = shared_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        stream, name, size = None, "", 0
        for batch in batches:
            for page_id, url, payload, response in zip(*(batch[c] for c in ("page_id", "url", "payload", "response"))):
                if stream is None:
                    name, system, inner = new_file(folder, ".warc")
                    stream, size = system.open_output_stream(inner), 0
                refers = record_id(response.as_py()) if response.as_py() is not None else None
                size += stream.write(record(page_id.as_py(), url.as_py(), payload.as_py(), refers))
                if size >= file_bytes:
                    stream.close()
                    done.append((name, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_bytes"])

    return written(rows.mapInArrow(write, "path string, n_bytes long"), "warc-files")


def _candidates(path: str, low: int, high: int, end: int) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The stretch (with what its last header has more) and, for each candidate that starts in it, where its header ends and where
    the next record would start.

    Headers are read to their blank line, whatever their length. A candidate without one or without a length leads nowhere and is
    left out. Places only move on from candidate to candidate, so many of them in one payload are still searched once.
    """
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as stream:
        data = stream.read_at(min(high + HEAD_BYTES, end) - low, low)
        starts = [m.start() for m in re.finditer(re.escape(MAGIC), data) if m.start() < high - low]
        size = HEAD_BYTES
        while starts and low + len(data) < end and data.find(b"\r\n\r\n", starts[-1]) < 0:
            size *= 2
            data += stream.read_at(min(size, end - low - len(data)), low + len(data))
    found = {}
    stop, length = -1, None
    for k, at in enumerate(starts):
        if stop < at:
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0:
                break
        if k == 0 or length is not None and length.start() < at:
            length = _LENGTH.search(data, at)
        if length is not None and length.end() <= stop + 2:
            found[low + at] = (low + stop, low + stop + 4 + int(length[1]) + 4)
    return data, found


def entries(stretches: DataFrame) -> DataFrame:
    """path, at: the first true record of every stretch that has one, from candidate links by pointer jumping.

    A file whose chain of records does not end exactly where the file does fails the job.
    """

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, follows = _candidates(row.path, row.low, row.high, row.n_bytes)
                exits: dict[int, int] = {}
                for at in sorted(follows, reverse=True):  # a link leads forward, so its end is known already
                    exits[at] = exits.get(follows[at][1], follows[at][1] if follows[at][1] >= row.high else -1)
                good = [(at, to) for at, to in exits.items() if to >= 0]
                yield pd.DataFrame({"path": row.path, "at": [g[0] for g in good], "to": [g[1] for g in good]})

    jumps = written(stretches.mapInPandas(links, "path string, at long, to long"), "warc-links")
    # Only places that some stretch leads to, and file starts, can be entries.
    led = jumps.select("path", F.col("to").alias("at")).distinct()
    jumps = written(jumps.join(led, ["path", "at"], "left_semi").union(jumps.where("at = 0")).distinct(), "warc-jumps")
    reached = jumps.where("at = 0").select("path", "at")
    count = -1
    while True:
        ahead = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = written(reached.union(ahead).distinct(), "warc-reached")
        before, count = count, reached.count()
        if count == before:
            break
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.path = b.path AND a.to = b.at"), "left")
        jumps = written(twice.select("a.path", "a.at", F.coalesce("b.to", "a.to").alias("to")), "warc-jumps")
    ends = stretches.where("n_bytes > 0").select("path", F.col("n_bytes").alias("at")).distinct()
    broken = ends.join(reached, ["path", "at"], "left_anti").first()
    if broken is not None:
        raise ValueError(f"the records of {broken['path']} do not lead to its end at {broken['at']}")
    return reached


RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def read_archives(spark: SparkSession, files: DataFrame, stretch_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """The records of archives written above: RECORD's columns. A revisit has its payload's size and digest, and no payload.

    ``files`` has path and n_bytes. Files are read in stretches by many tasks. The digest of a response is checked against its
    payload; a record that breaks off or has another digest fails the job, and so does a file that its records do not fill. Empty ``files`` give an empty result.
    """
    stretches = files.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {stretch_bytes}"))).alias("k"))
    stretches = stretches.select("path", "n_bytes", (F.col("k") * stretch_bytes).alias("low"), F.least(F.col("n_bytes"), (F.col("k") + 1) * stretch_bytes).alias("high"))
    # A number of partitions of its own: these rows are few and small, and what they stand for is not.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretches = written(stretches, "warc-stretches").repartition(tasks, "path", "low")
    true = entries(stretches).withColumn("low", F.expr(f"at div {stretch_bytes} * {stretch_bytes}"))
    true = stretches.join(true, ["path", "low"]).repartition(tasks, "path", "low")
    schema = RECORD if with_payload else T.StructType(RECORD.fields[:-1])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, n_bytes, high, at in zip(*(batch[c].to_pylist() for c in ("path", "low", "n_bytes", "high", "at"))):
                data, follows = _candidates(path, low, high, n_bytes)
                system, inner = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                while at < high:
                    head_end, following = follows[at]
                    head = dict(line.split(": ", 1) for line in data[at - low + len(MAGIC) : head_end - low].decode().split("\r\n"))
                    start, end = head_end + 4, following - 4
                    if end - low <= len(data):
                        block = data[start - low : end - low]
                    else:
                        with system.open_input_file(inner) as stream:
                            block = stream.read_at(end - start, start)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(_LENGTH.search(http + b"\r\n")[1])
                    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != stated):
                        raise ValueError(f"the payload at {at} in {path} is not what its record states")
                    refers = head.get("WARC-Refers-To")
                    row = {"page_id": page_number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated, "record_type": head["WARC-Type"], "refers_to": page_number(refers) if refers else None}
                    rows.append(row | ({"payload": payload} if with_payload else {}))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW if with_payload else pa.schema(list(ARROW)[:-1]))
                        rows = []
                    at = following
                yield pa.RecordBatch.from_pylist(rows, ARROW if with_payload else pa.schema(list(ARROW)[:-1]))

    return true.select("path", "low", "n_bytes", "high", "at").mapInArrow(read, schema)


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
