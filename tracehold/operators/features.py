"""Node index, hashed features and edge index for the graph model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.hashing import broadcast_vectors, feature_seed
from tracehold.functions.text import or_default
from tracehold.operators.normalize import log_command
from tracehold.operators.skew import join_ends
from tracehold.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_index(frame: DataFrame, order_by: list[str], name: str = "idx", path: str | None = None) -> DataFrame:
    """Number the rows 0..n-1 in sorted order, without one task seeing them all.

    The frame is range-sorted and written with its per-task row numbers; the
    offset of each task is a running sum over one row per task, which is what
    gets broadcast.
    """
    numbered = frame.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id())
    stored = materialize(numbered, f"index-{name}", path)
    part, row = F.shiftright("_slot", _ROW_BITS), F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_part", "_slot", "_offset")
    )


def node_index(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """(id, idx, seed): dense number and feature seed of each node, in id order."""
    rows = nodes.select("id", feature_seed(F.col("cmd_line")).alias("seed"))
    return dense_index(rows, ["id"], "idx", path).select("id", "idx", "seed")


def edge_index(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst) as node numbers; edges with an endpoint that is no node drop out."""
    source = index.select(F.col("id").alias("_a"), F.col("idx").alias("_s"))
    target = index.select(F.col("id").alias("_b"), F.col("idx").alias("_d"))
    return join_ends(edges.select("src", "dst"), source, "_a", target, "_b").select(
        F.col("_s").alias("src"), F.col("_d").alias("dst")
    )


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are nodes, with their text ids."""
    source = nodes.select(F.col("id").alias("_a"))
    target = nodes.select(F.col("id").alias("_b"))
    return join_ends(edges, source, "_a", target, "_b").select(*edges.columns)


def node_features(index: DataFrame) -> DataFrame:
    """(idx, x0..x15): the vector of each node's seed. Row-local.

    The dictionary has a fixed 100,000 rows (6.4 MB) and is broadcast.
    """
    table = broadcast_vectors(index.sparkSession)
    names = [f"x{i}" for i in range(fv.FEATURE_WIDTH)]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(table.value[batch["seed"].to_numpy()], columns=names)
            out.insert(0, "idx", batch["idx"].to_numpy())
            yield out

    schema = "idx long, " + ", ".join(f"{n} float" for n in names)
    return index.select("idx", "seed").mapInPandas(fill, schema)


def parent_text() -> Column:
    return F.coalesce("parent_process_id", F.lit(fv.UNKNOWN_PARENT))


def fingerprint() -> Column:
    """name_command_user of a log, the text its own feature vector comes from."""
    return F.concat_ws(
        "_",
        F.coalesce("process_name", F.lit(fv.UNKNOWN_TEXT)),
        F.coalesce(log_command(), F.lit("")),
        F.coalesce("user_id", F.lit(fv.UNKNOWN_TEXT)),
    )


def with_seeds(logs: DataFrame) -> DataFrame:
    """Add ``parent_seed`` and ``child_seed``."""
    return logs.withColumns(
        {"parent_seed": feature_seed(parent_text()), "child_seed": feature_seed(fingerprint())}
    )


def shown_command(chars: int = fv.SHOWN_COMMAND_CHARS) -> Column:
    return F.substring(or_default(log_command(), fv.UNKNOWN_TEXT), 1, chars)
