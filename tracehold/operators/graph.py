"""Provenance graph from logs: process, file and network nodes, typed edges.

All upserts are one grouped aggregation each, combined map-side before the
shuffle, so a process that holds a third of all logs costs its reducer one row
per map task. "First" and "last" are by input position, never by row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.operators.normalize import (
    event_kind, event_time_number, node_command, parent_key, process_key,
)
from tracehold.sources.json_logs import INPUT_ORDER


def _position(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _node_rows(
    logs: DataFrame, order: Sequence[str], props: dict[str, Column], parent_id: Column
) -> DataFrame:
    """One row for the log's own process and one for its parent, in a single scan."""
    own = F.struct(
        process_key().alias("id"),
        _position(order).alias("at"),
        F.lit(0).alias("role"),
        *[value.alias(name) for name, value in props.items()],
    )
    parent = F.struct(
        parent_id.alias("id"),
        _position(order).alias("at"),
        F.lit(1).alias("role"),
        *[F.lit(None).alias(name) for name in props],
    )
    return logs.select(F.inline(F.array(own, parent))).filter(F.col("id").isNotNull())


def process_nodes(logs: DataFrame, order: Sequence[str] = INPUT_ORDER, keep: str = "last") -> DataFrame:
    """Process nodes: every child and every parent, once.

    ``keep='last'``: (id, cmd_line), the command of the process's last log; NULL
    for processes seen only as parents.
    ``keep='first'``: (id, cmd_line, user_id, is_evil) from whatever named the
    process first; NULL if it was first named as a parent. Parent ids are taken as
    written, as in ``typed_edges``.
    """
    if keep == "last":
        rows = _node_rows(logs, order, {"cmd_line": node_command()}, parent_key())
        at = F.when(F.col("role") == 0, F.col("at"))
        return rows.groupBy("id").agg(F.max_by("cmd_line", at).alias("cmd_line"))
    if keep != "first":
        raise ValueError("keep is 'last' or 'first'")
    props = {c: F.col(c) for c in ("cmd_line", "user_id", "is_evil")}
    rows = _node_rows(logs, order, props, F.col("parent_process_id"))
    first = F.min_by(F.struct(*props), F.struct("at", "role"))
    return rows.groupBy("id").agg(first.alias("p")).select("id", "p.*")


def spawn_links(logs: DataFrame, order: Sequence[str] = INPUT_ORDER) -> DataFrame:
    """(src, dst, cmd_line, at): each parent-child pair with the child's last command
    seen there; ``src`` is NULL for logs without a parent.

    The one pass over the logs that both nodes and edges are made from: its size is
    that of the graph, and rows of several loads merge with ``merge_links``.
    """
    rows = logs.select(
        parent_key().alias("src"),
        process_key().alias("dst"),
        node_command().alias("cmd_line"),
        _position(order).alias("at"),
    )
    return merge_links(rows)


def merge_links(links: DataFrame) -> DataFrame:
    """One row per (src, dst), the last command by input position."""
    return links.groupBy("src", "dst").agg(
        F.max_by("cmd_line", "at").alias("cmd_line"), F.max("at").alias("at")
    )


def nodes_of(links: DataFrame) -> DataFrame:
    """Process nodes (id, cmd_line) of links: every child and every parent, once."""
    child = F.struct(F.col("dst").alias("id"), "cmd_line", "at")
    parent = F.struct(
        F.col("src").alias("id"), F.lit(None).alias("cmd_line"), F.lit(None).alias("at")
    )
    return (
        links.select(F.inline(F.array(child, parent)))
        .filter(F.col("id").isNotNull())
        .groupBy("id").agg(F.max_by("cmd_line", "at").alias("cmd_line"))
    )


def edges_of(links: DataFrame) -> DataFrame:
    """Spawn edges (src, dst) of links that are unique by pair."""
    return links.filter(F.col("src").isNotNull()).select("src", "dst")


def spawn_edges(logs: DataFrame) -> DataFrame:
    """Distinct (src, dst) parent-to-child edges; self-edges are kept."""
    return (
        logs.select(parent_key().alias("src"), process_key().alias("dst"))
        .filter(F.col("src").isNotNull())
        .distinct()
    )


def is_file_touch() -> Column:
    return F.col("file_path").isNotNull() & F.col("event_type").isin(*fv.FILE_EVENT_TYPES)


def is_network_touch() -> Column:
    """True for a remote address or a network event; never NULL."""
    return F.col("remote_ip").isNotNull() | F.coalesce(
        F.col("event_type").isin(*fv.NETWORK_EVENT_TYPES), F.lit(False)
    )


def _ip() -> Column:
    return F.coalesce("remote_ip", F.lit(fv.DEFAULT_IP))


def _port() -> Column:
    return F.coalesce("remote_port", F.lit(fv.DEFAULT_PORT))


def typed_edges(logs: DataFrame) -> DataFrame:
    """Distinct (rel, src, dst, port, timestamp, type) edges of all three kinds.

    Each log yields up to three edges in one scan; duplicates go map-side first.
    The parent of a spawn edge is taken as written here.
    """
    def edge(rel, src, dst, port):
        return F.struct(
            F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"), port.alias("port")
        )

    none = F.lit(None).cast("string")
    me, parent = process_key(), F.col("parent_process_id")
    edges = F.filter(
        F.array(
            F.when(parent.isNotNull(), edge(fv.SPAWNED, parent, me, none)),
            F.when(is_file_touch(), edge(fv.ACCESSED, me, F.col("file_path"), none)),
            F.when(is_network_touch(), edge(fv.CONNECTED_TO, me, _ip(), _port())),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        logs.select(
            event_time_number().alias("timestamp"), event_kind().alias("type"), F.inline(edges)
        )
        .select("rel", "src", "dst", "port", "timestamp", "type")
        .distinct()
    )


def file_nodes(logs: DataFrame) -> DataFrame:
    return logs.filter(is_file_touch()).select(F.col("file_path").alias("path")).distinct()


def network_nodes(logs: DataFrame) -> DataFrame:
    return logs.filter(is_network_touch()).select(_ip().alias("ip"), _port().alias("port")).distinct()


def touched(logs: DataFrame) -> DataFrame:
    """Distinct (id, kind, name): files and addresses touched by each process."""
    def item(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    items = F.filter(
        F.array(
            F.when(is_file_touch(), item("file", F.col("file_path"))),
            F.when(is_network_touch(), item("ip", _ip())),
        ),
        lambda i: i.isNotNull(),
    )
    return logs.select(process_key().alias("id"), F.inline(items)).distinct()


def files_of(edges: DataFrame) -> DataFrame:
    """Distinct (path) nodes of typed edges."""
    return edges.filter(F.col("rel") == fv.ACCESSED).select(F.col("dst").alias("path")).distinct()


def networks_of(edges: DataFrame) -> DataFrame:
    """Distinct (ip, port) nodes of typed edges."""
    return edges.filter(F.col("rel") == fv.CONNECTED_TO).select(F.col("dst").alias("ip"), "port").distinct()


def touched_of(edges: DataFrame) -> DataFrame:
    """What ``touched`` finds in the logs, from their stored typed edges."""
    kind = F.when(F.col("rel") == fv.ACCESSED, "file").otherwise("ip")
    touches = edges.filter(F.col("rel").isin(fv.ACCESSED, fv.CONNECTED_TO))
    return touches.select(F.col("src").alias("id"), kind.alias("kind"), F.col("dst").alias("name")).distinct()
