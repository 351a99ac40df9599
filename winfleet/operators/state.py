"""Latest state from change logs, status changes and audits of status transitions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winfleet.functions.settings import STATUS_DEFAULTS, or_default_if_blank

# Operations of a change log.
CHANGED, DELETED, RESET = "CHANGED", "DELETED", "RESET"

# Transitions between statuses that the running system makes, and those its diagrams show.
_STATUSES = ("Unknown", "Starting", "Started", "Stopping", "Stopped", "Terminated")
JOB_TRANSITIONS = {
    "Unknown": {"Starting", "Terminated"},
    "Starting": {"Started", "Stopping", "Stopped"},
    "Started": {"Stopping", "Stopped"},
    "Stopping": {"Stopped", "Starting", "Terminated"},
    "Stopped": {"Stopping", "Starting", "Started"},
}
JOB_TRANSITIONS_DRAWN = {
    "Unknown": {"Unknown", "Starting", "Terminated"},
    "Starting": {"Starting", "Started", "Stopping", "Stopped"},
    "Started": {"Stopping"},
    "Stopping": {"Stopped", "Starting", "Terminated"},
    "Stopped": {"Stopping", "Starting", "Started"},
}
CLUSTER_TRANSITIONS = {
    "Unknown": {"Starting", "Terminated"},
    "Starting": {"Started", "Stopping"},
    "Started": {"Stopping"},
    "Stopping": {"Stopped", "Starting", "Terminated"},
    "Stopped": {"Stopping"},
}
CLUSTER_TRANSITIONS_DRAWN = {
    "Unknown": {"Starting", "Terminated"},
    "Starting": {"Started", "Stopping"},
    "Started": {"Stopping"},
    "Stopping": {"Stopped", "Starting", "Terminated"},
    "Stopped": {"Starting", "Stopping"},
}
# A job whose cluster is missing falls back from any status.
JOB_FALLBACK = {"Unknown"}

# How long a status is remembered without being observed again.
REMEMBERED = timedelta(seconds=300)


def latest_state(
    changes: DataFrame, key: list[str], seq: str = "seq", op: str = "op", scope: list[str] | None = None
) -> DataFrame:
    """The live row of every key: its last change after the last reset, unless that change is a delete.

    A reset clears every key, or every key of its ``scope`` columns (say, the kind of resource). ``seq`` is unique and
    orders the log. The maximum per key is built up before the shuffle, so the length of a key's history does not matter.
    Reading only rows behind the last reset is left to a runtime filter on ``seq``, which the scan applies as well.
    """
    columns = [c for c in changes.columns if c not in key]
    resets = changes.where(F.col(op) == RESET)
    if scope:
        # One row per key and scope is left before it meets its scope's last reset, so the log is never dealt by scope.
        last = resets.groupBy(*scope).agg(F.max(seq).alias("_reset"))
        group = [*key, *[c for c in scope if c not in key]]
        kept = [c for c in columns if c not in scope]
        alive = latest_by(changes.where(F.col(op) != RESET), group, seq, kept).join(last, scope, "left")
        alive = alive.where(F.col("_reset").isNull() | (F.col(seq) > F.col("_reset"))).drop("_reset")
        if len(group) == len(key):
            return alive.where(F.col(op) != DELETED).select(*changes.columns)
    else:
        last = resets.select(F.coalesce(F.max(seq), F.lit(-(2**63))).alias("_reset"))
        alive = changes.where((F.col(op) != RESET) & (F.col(seq) > last.scalar()))
    newest = latest_by(alive, key, seq, columns)
    return newest.where(F.col(op) != DELETED).select(*changes.columns)


def compacted(changes: DataFrame, key: list[str], seq: str = "seq", op: str = "op", scope: list[str] | None = None) -> DataFrame:
    """The shortest change log with the same latest state: the last row per key and the last reset.

    Logs compacted piece by piece and joined end to end give the same state as the whole log, deletes included.
    """
    scope = scope or []
    identity = [F.when(F.col(op) != RESET, F.col(c)).alias(f"_k_{c}") for c in key if c not in scope]
    marked = changes.select("*", *identity, (F.col(op) == RESET).alias("_reset"))
    group = ["_reset", *scope, *[f"_k_{c}" for c in key if c not in scope]]
    rows = marked.groupBy(*group).agg(F.max_by(F.struct(*changes.columns), seq).alias("_row"))
    return rows.select("_row.*")


def latest_by(rows: DataFrame, key: list[str], order: str | Column, columns: list[str]) -> DataFrame:
    """One row per key with the columns of the row whose ``order`` is largest. ``order`` is unique within a key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*key, "_row.*")


def newest_per_name(rows: DataFrame, name: str, uploaded: str, tie: str) -> DataFrame:
    """The most recently uploaded row of every name; ties go to the larger ``tie``."""
    columns = [c for c in rows.columns if c != name]
    return latest_by(rows, [name], F.struct(uploaded, tie), columns).select(*rows.columns)


def with_previous(
    rows: DataFrame, key: str, time: str, seq: str, columns: list[str], block: str | None = "hour"
) -> DataFrame:
    """Add ``previous``: a struct of ``columns`` of the key's row before this one in order of ``(time, seq)``, null at first.

    A plain lag would sort a key's whole history in one task. Here a key's history is cut at calendar units (``block``: hour,
    day, month, ...) and the lag runs per key and block, which leaves out the first row of each block. The row before that one
    is the last of the key's block before, so a second lag runs over the first and last rows of blocks alone: at most two per
    key and unit of time, however many rows there are. Both parts start from the same scan and shuffle, which Spark runs once:
    columns bear other names inside, because an alias that keeps a column's name is removed in one part and not in the other.
    ``block=None`` is the plain lag, for short histories. Keys are not null.
    """
    if block is None:
        whole = Window.partitionBy(key).orderBy(time, seq)
        return rows.select("*", F.lag(F.struct(*columns)).over(whole).alias("previous"))
    start = F.coalesce(F.unix_seconds(F.date_trunc(block, F.col(time))), F.lit(-(2**63)))
    blocked = rows.select(*[F.col(c).alias(f"_in_{c}") for c in rows.columns], start.alias("_block"))
    order = [F.col(f"_in_{time}"), F.col(f"_in_{seq}")]
    whole = Window.partitionBy(f"_in_{key}").orderBy(*order)
    inside = Window.partitionBy(f"_in_{key}", "_block").orderBy(*order)
    restored = [F.col(f"_in_{c}").alias(c) for c in rows.columns]
    first = F.lag(F.lit(False), 1, True).over(inside).alias("_first")
    last = F.lead(F.lit(False), 1, True).over(inside).alias("_last")
    # Lags of plain columns, put together afterwards: both parts then feed the same columns to their shuffle.
    before = [F.lag(f"_in_{column}").over(inside).alias(f"_before_{column}") for column in columns]
    previous = F.struct(*[F.col(f"_before_{column}").alias(column) for column in columns])
    inner = blocked.select("*", first, *before).where("NOT _first").select(*restored, previous.alias("previous"))
    edges = blocked.select("*", first, last).where("_first OR _last")
    last_one = F.struct(*[F.col(f"_in_{column}").alias(column) for column in columns])
    edges = edges.select("*", F.lag(last_one).over(whole).alias("previous")).where("_first")
    return inner.unionAll(edges.select(*restored, "previous"))


def status_changes(
    rows: DataFrame,
    key: str,
    time: str = "ts",
    seq: str = "seq",
    watched: tuple[str, ...] = ("status",),
    remembered: timedelta = REMEMBERED,
    block: str | None = "hour",
) -> DataFrame:
    """Rows that tell something new: a key's first, one that differs from the key's previous row in a watched column, or one
    that follows it by more than ``remembered`` (every observation renews the memory)."""
    seen = with_previous(rows, key, time, seq, [time, *watched], block)
    differs = F.lit(False)
    for column in watched:
        differs = differs | ~F.col(column).eqNullSafe(F.col("previous")[column])
    forgotten = F.col(time) > F.col("previous")[time] + F.lit(remembered)
    return seen.where(F.col("previous").isNull() | differs | forgotten).drop("previous")


def illegal_transitions(
    rows: DataFrame,
    key: str,
    allowed: dict[str, set[str]],
    always: set[str] | None = None,
    time: str = "ts",
    seq: str = "seq",
    status: str = "status",
    block: str | None = "hour",
) -> DataFrame:
    """Changes of status that the table of allowed transitions does not have, with ``previous_status``.

    ``always`` lists statuses that may follow any other. The table is a constant of the state machine, so it becomes a set of
    literals inside the filter instead of a join. A missing or blank status reads as Unknown.
    """
    pairs = {(before, after) for before, afters in allowed.items() for after in afters}
    pairs |= {(before, after) for before in _STATUSES for after in always or set()}
    known = rows.withColumn("_status", or_default_if_blank(F.col(status), STATUS_DEFAULTS["supervisor_status"]))
    seen = with_previous(known, key, time, seq, ["_status"], block)
    before, after = F.col("previous")["_status"], F.col("_status")
    legal = F.concat_ws(">", before, after).isin(sorted(f"{a}>{b}" for a, b in pairs))
    moved = seen.where(F.col("previous").isNotNull() & (before != after) & ~legal)
    return moved.withColumn("previous_status", before).drop("previous", "_status")
