"""Two-hop ancestry and touched artifacts per process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import or_default
from tracehold.operators.skew import hot_keys, lookup
from tracehold.session import materialize


def first_parent(edges: DataFrame) -> DataFrame:
    """(id, parent_id): the smallest parent id of each process that has one.

    A process may have several recorded parents; the context shows one of them.
    Choosing before joining keeps every later step at one row per process.
    """
    return edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent_id"))


def ancestry(nodes: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(id, cmd_line, parent_id, parent_cmd, gp_id, gp_cmd), one row per process.

    Outer at both hops: missing ancestors are NULL. With ``targets`` (a frame
    with an ``id`` column) only those processes and their ancestors are read;
    ids that are not in the graph give no row.
    """
    if targets is not None:
        return _ancestry_of(nodes, edges, targets)
    # stored: the count of hot keys and both hops read it
    family = materialize(nodes.select("id", "cmd_line").join(first_parent(edges), "id", "left"), "family")
    hot = hot_keys(family, "parent_id")
    parents = nodes.select(F.col("id").alias("_p"), F.col("cmd_line").alias("parent_cmd"))
    one_hop = lookup(family, "parent_id", parents, "_p", hot=hot).drop("_p")
    # The second hop joins on the same key: the parent's parent is the grandparent.
    above = one_hop.select(
        F.col("id").alias("_p"),
        F.col("parent_id").alias("gp_id"),
        F.col("parent_cmd").alias("gp_cmd"),
    )
    return lookup(one_hop, "parent_id", above, "_p", hot=hot).drop("_p")


def _family(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cmd_line, parent_id) of the wanted ids, stored.

    The graph tables are only semi-joined, so where the ids are few they are
    broadcast and the tables are not shuffled; storing gives the next hop's
    plan the real (small) size.
    """
    wanted = ids.filter(F.col("id").isNotNull()).distinct()
    own = nodes.select("id", "cmd_line").join(wanted, "id", "left_semi")
    up = first_parent(edges.join(wanted.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return materialize(own.join(up, "id", "left"), "family")


def _ancestry_of(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Ancestry hop by hop from the wanted ids."""
    own = _family(nodes, edges, targets.select("id"))
    parents = _family(nodes, edges, own.select(F.col("parent_id").alias("id")))
    gp_ids = parents.select(F.col("parent_id").alias("id")).distinct()
    grandparents = nodes.select("id", "cmd_line").join(gp_ids, "id", "left_semi")
    above = lookup(
        parents.withColumnsRenamed({"id": "_p", "cmd_line": "parent_cmd", "parent_id": "gp_id"}),
        "gp_id",
        grandparents.withColumnsRenamed({"id": "_g", "cmd_line": "gp_cmd"}),
        "_g",
    ).drop("_g")
    return lookup(own, "parent_id", above, "_p").drop("_p").select(
        "id", "cmd_line", "parent_id", "parent_cmd", "gp_id", "gp_cmd"
    )


def artifacts(
    touches: DataFrame, n_files: int = fv.SHOWN_FILES, n_ips: int = fv.SHOWN_IPS
) -> DataFrame:
    """(id, files, ips, file_count, ip_count) per process that touched anything.

    ``touches`` holds distinct (id, kind, name). The lists hold the first names
    in order, as many as the context shows. A ranked filter keeps that many per
    map task before the shuffle, so a process with millions of files sends few
    rows; the counts are over all names.
    """
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("name"))
    shown = (
        touches.withColumn("_rank", rank)
        .filter(F.col("_rank") <= max(n_files, n_ips))
        .filter(F.col("_rank") <= F.when(F.col("kind") == "file", n_files).otherwise(n_ips))
    )

    def names(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))

    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    lists = shown.groupBy("id").agg(names("file").alias("files"), names("ip").alias("ips"))
    counts = touches.groupBy("id").agg(
        count("file").alias("file_count"), count("ip").alias("ip_count")
    )
    return lists.join(counts, "id")


def short_context() -> Column:
    """Three-line ancestry text from the columns of ``ancestry``."""
    return F.format_string(
        fv.SHORT_CONTEXT_FORMAT,
        or_default(F.col("gp_cmd"), "None"),
        or_default(F.col("parent_cmd"), "Unknown"),
        or_default(F.col("cmd_line"), "Unknown"),
    )


def long_context() -> Column:
    """Ancestry and artifacts text from the columns of ``ancestry`` and ``artifacts``."""
    def listed(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(F.lit("None"))

    return F.format_string(
        fv.LONG_CONTEXT_FORMAT,
        or_default(F.col("gp_cmd"), "Unknown"),
        or_default(F.col("parent_cmd"), "Unknown"),
        or_default(F.col("cmd_line"), "Unknown"),
        listed("files"),
        listed("ips"),
    )


def short_contexts(nodes: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(id, context) in the short form."""
    return ancestry(nodes, edges, targets).select("id", short_context().alias("context"))


def long_contexts(
    nodes: DataFrame, edges: DataFrame, touches: DataFrame, targets: DataFrame | None = None
) -> DataFrame:
    """(id, context) in the long form."""
    if targets is not None:
        touches = touches.join(targets.select("id").distinct(), "id", "left_semi")
    chain = ancestry(nodes, edges, targets)
    return chain.join(artifacts(touches), "id", "left").select(
        "id", long_context().alias("context")
    )


def attach_context(rows: DataFrame, contexts: DataFrame, default: str) -> DataFrame:
    """Add ``context`` to rows by their ``process_id``; the default where the graph has none.

    Rows repeat process ids (one process may raise a third of all alerts), so
    hot ids are spread.
    """
    table = contexts.select(F.col("id").alias("_id"), "context")
    return (
        lookup(rows, "process_id", table, "_id")
        .withColumn("context", F.coalesce("context", F.lit(default)))
        .drop("_id")
    )
