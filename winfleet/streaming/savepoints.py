"""Start a stream from a chosen saved state.

Every committed micro-batch of a query is a saved state: its offsets, its commit, the version of every state store after it, and what
file sources had seen by then. ``fork_checkpoint`` makes a checkpoint of its own out of one of them; a query started there goes on
after that batch, with any later input, while the first query is left as it is and may run on. The fork gets a new query id,
so both may run in one session.

Spark keeps the last ``spark.sql.streaming.minBatchesToRetain`` (100) batches, so these can be chosen. The driver lists names, tasks copy
files. Paths are local or URIs that Arrow can open.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = re.compile(r"\d+")
# Files of a state store's partition: version, in newer formats a mark of the attempt, and the kind.
_STATE_FILE = re.compile(r"(\d+)(?:_[^.]*)?\.(?:delta|snapshot|zip|changelog)")


def _under(base: str) -> tuple[fs.FileSystem, str]:
    filesystem, path = fs.FileSystem.from_uri(base)
    return filesystem, path.rstrip("/")


def _names(filesystem: fs.FileSystem, folder: str, recursive: bool = False) -> list[str]:
    """Names of files below a folder, relative to it, without hidden ones (checksums, unfinished files)."""
    found = filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))
    names = [f.path[len(folder) + 1 :] for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not n.rsplit("/", 1)[-1].startswith("."))


def _numbered(filesystem: fs.FileSystem, folder: str) -> list[int]:
    return sorted(int(n) for n in _names(filesystem, folder) if _NUMBER.fullmatch(n))


def saved_batches(checkpoint: str) -> list[int]:
    """Micro-batches after which a query can be started: committed, with their offsets, the one before and all state kept."""
    filesystem, base = _under(checkpoint)
    offsets, commits = set(_numbered(filesystem, f"{base}/offsets")), _numbered(filesystem, f"{base}/commits")
    versions: dict[str, set[int]] = {}
    for name in _names(filesystem, f"{base}/state", recursive=True):
        place, file = name.rsplit("/", 1) if "/" in name else ("", name)
        if match := _STATE_FILE.fullmatch(file):
            versions.setdefault(place, set()).add(int(match[1]))
    held = set.intersection(*versions.values()) if versions else None
    return [b for b in commits if b in offsets and (b == 0 or b - 1 in offsets) and (held is None or b + 1 in held)]


def watermark_of(checkpoint: str, batch: int) -> int:
    """The watermark in force in a micro-batch that has begun, in epoch milliseconds; 0 while there is none."""
    filesystem, base = _under(checkpoint)
    with filesystem.open_input_stream(f"{base}/offsets/{batch}") as file:
        return json.loads(file.read().decode().splitlines()[1])["batchWatermarkMs"]


def _source_ends(filesystem: fs.FileSystem, base: str, batch: int) -> dict[str, int]:
    """For each file source (by number), the last entry of its list of seen files that the batch had."""
    with filesystem.open_input_stream(f"{base}/offsets/{batch}") as file:
        lines = file.read().decode().splitlines()[2:]
    ends = {}
    for number, line in enumerate(lines):
        offset = json.loads(line) if line.startswith("{") else None
        if isinstance(offset, dict) and "logOffset" in offset:
            ends[str(number)] = offset["logOffset"]
    return ends


def _belongs(name: str, batch: int, ends: dict[str, int]) -> bool:
    """Whether a file of a checkpoint is part of the state after a batch."""
    top, _, rest = name.partition("/")
    file = name.rsplit("/", 1)[-1]
    number = _NUMBER.match(file)
    if top in ("offsets", "commits"):
        return bool(number) and int(number[0]) <= batch
    if top == "sources":
        source = rest.split("/", 1)[0]
        return source not in ends or not number or int(number[0]) <= ends[source]
    if top == "state" and "/_" not in name:  # schemas and metadata are in folders that start with _
        return not (match := _STATE_FILE.match(file)) or int(match[1]) <= batch + 1
    return top != "metadata"


def fork_checkpoint(spark: SparkSession, checkpoint: str, target: str, batch: int) -> None:
    """Make ``target`` a checkpoint that stands after micro-batch ``batch`` of the query at ``checkpoint``.

    Raises ValueError if that batch was never committed or is no longer kept, or if ``target`` exists. Seen files and state of later
    batches are left out, so the fork reads later files anew.
    """
    filesystem, base = _under(checkpoint)
    other, goal = _under(target)
    known = saved_batches(checkpoint)
    if batch not in known:
        raise ValueError(f"no saved state after batch {batch}; there are {known}")
    if _names(other, goal, recursive=True):
        raise ValueError(f"{target} exists")
    ends = _source_ends(filesystem, base, batch)
    chosen = [n for n in _names(filesystem, base, recursive=True) if _belongs(n, batch, ends)]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        source, start = fs.FileSystem.from_uri(checkpoint)
        sink, end = fs.FileSystem.from_uri(target)
        for part in batches:
            for name in part["name"].to_pylist():
                where = f"{end.rstrip('/')}/{name}"
                sink.create_dir(where.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(f"{start.rstrip('/')}/{name}", where, source_filesystem=source, destination_filesystem=sink)
            yield part

    tasks = max(1, min(len(chosen) // 16, spark.sparkContext.defaultParallelism * 4))
    names = spark.createDataFrame([(n,) for n in chosen], "name string").repartition(tasks)
    done = names.mapInArrow(copy, "name string").agg(F.count("*")).first()[0]
    if done != len(chosen):
        raise RuntimeError(f"copied {done} of {len(chosen)} files")
    with other.open_output_stream(f"{goal}/metadata") as out:  # last: without it, Spark takes the folder for no checkpoint
        out.write(json.dumps({"id": str(uuid.uuid4())}).encode())


def state_at(spark: SparkSession, checkpoint: str, batch: int, operator: int = 0) -> DataFrame:
    """key, value and partition of an operator's state after a micro-batch, by Spark's state data source."""
    reader = spark.read.format("statestore").option("batchId", batch).option("operatorId", operator)
    return reader.load(checkpoint)
