"""One canonical log schema from the field-name dialects of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracehold.functions import fixed_values as fv

# Canonical column -> (type, source names in order of preference).
CANONICAL = {
    "timestamp": ("double", ("timestamp",)),
    "timestamp_ns": ("long", ("timestamp_ns",)),
    "event_type": ("string", ("event_type",)),
    "process_id": ("string", ("processId", "process_id")),
    "parent_process_id": ("string", ("parentProcessId", "parent_process_id")),
    "thread_id": ("string", ("threadId", "thread_id")),
    "process_name": ("string", ("processName", "process_name")),
    "args": ("string", ("args",)),
    "cmd_line": ("string", ("cmdLine", "cmd_line")),
    "user_id": ("string", ("userId", "user_id")),
    "return_value": ("string", ("return_value",)),
    "file_path": ("string", ("file_path",)),
    "remote_ip": ("string", ("remote_ip",)),
    "remote_port": ("string", ("remote_port",)),
    "is_suspicious": ("int", ("is_suspicious",)),
    "is_evil": ("int", ("is_evil",)),
}
LABELS = ("is_suspicious", "is_evil")


def label(column: Column) -> Column:
    """0/1 label from a number, boolean or text; 0 where it is missing or none of these."""
    return F.coalesce(
        column.try_cast("double").try_cast("int"),
        F.when(F.lower(column) == "true", F.lit(1)),
        F.lit(0),
    )


def canonical_logs(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project any source frame to the canonical columns (plus ``keep``).

    Columns a source lacks are NULL (labels 0).
    """
    present = set(raw.columns)
    columns = []
    for name, (kind, sources) in CANONICAL.items():
        found = [F.col(s).cast("string") for s in sources if s in present]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        if name in LABELS:
            value = label(value)
        elif kind != "string":
            value = value.try_cast(kind)
        columns.append(value.alias(name))
    carried = [c for c in ("src_file", "src_block", "src_row", "split", *keep) if c in present]
    return raw.select(*dict.fromkeys(carried), *columns)


def process_key(use_thread: bool = True) -> Column:
    """Id of the log's process, ``UNKNOWN`` where there is none."""
    ids = ["process_id", "thread_id"] if use_thread else ["process_id"]
    return F.coalesce(*ids, F.lit(fv.UNKNOWN_PROCESS))


def parent_key() -> Column:
    """Id of the parent process; NULL for no parent and for texts that mean none."""
    parent = F.col("parent_process_id")
    return F.when(~parent.isin(*fv.NO_PARENT_WORDS), parent)


def node_command() -> Column:
    """Command text of a graph node; an empty text is kept as it is."""
    return F.coalesce("args", "process_name", "cmd_line", F.lit(fv.UNKNOWN_TEXT))


def log_command() -> Column:
    """Command text of a log for scoring: arguments, else command line, else NULL."""
    return F.coalesce("args", "cmd_line")


def event_time_number() -> Column:
    """The log's time as an exact number: nanoseconds, else seconds, else 0.

    Decimal, because edges are distinct by it and a double merges nearby nanoseconds.
    """
    exact = "decimal(38,9)"
    return F.coalesce(
        F.col("timestamp_ns").cast(exact), F.col("timestamp").try_cast(exact), F.lit(0).cast(exact)
    )


def event_kind() -> Column:
    return F.coalesce("event_type", F.lit(fv.UNKNOWN_EVENT))
