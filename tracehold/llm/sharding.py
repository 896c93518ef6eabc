"""Placement on shards by a hierarchical weighted hash tree, with DataFrame functions only.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with a uniform ``u`` hashed from the document's key and the child's name;
the smallest draw wins. A child's draw depends on nothing but the key, its name and its weight,
so a new or heavier subtree takes rows only into itself at its level, and what lies in subtrees
whose weights stay is not touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.common import stored

#: Rows that are numbered together; the offset of each such run of rows is added afterwards.
RUN_ROWS = 1 << 16


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int = 16, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Equal shards, so many in a rack, so many racks in a region."""
    return [Leaf(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own.

    The weights of the other regions stay, so every row that moves, moves to the new shard.
    """
    new = max((leaf.shard for leaf in leaves), default=-1) + 1
    return [*leaves, Leaf(f"region+{new}", f"rack+{new}", new, weight)]


def _weights(leaves: Sequence[Leaf], level: str) -> dict[str | int, float]:
    out: dict[str | int, float] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            out[getattr(leaf, level)] = out.get(getattr(leaf, level), 0.0) + leaf.weight
    return out


def _draw(key: Column, level: str, children: dict[str | int, float]) -> Column:
    """The child with the smallest draw; the smaller name where draws tie."""
    draws = []
    for name, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{name}")), 11)
        uniform = (bits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(uniform) / F.lit(weight)).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"] if len(draws) > 1 else draws[0]["name"]


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key (a string column without nulls).

    Leaves of weight 0 take nothing. A topology without weight is an error.
    """
    regions = _weights(leaves, "region")
    if not regions:
        raise ValueError("no shard has a weight")

    def descend(level: str, rest: Sequence[Leaf]) -> Column:
        children = _weights(rest, level)
        if level == "shard":
            return _draw(key, level, children).cast("int")
        below = {"region": "rack", "rack": "shard"}[level]
        parts = {name: descend(below, [x for x in rest if getattr(x, level) == name]) for name in sorted(children)}
        if len(parts) == 1:
            return next(iter(parts.values()))
        chosen, out = _draw(key, level, children), None
        for name, column in parts.items():
            out = F.when(chosen == name, column) if out is None else out.when(chosen == name, column)
        return out

    return descend("region", list(leaves))


def shard_documents(documents: DataFrame, leaves: Sequence[Leaf], more: Sequence[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``more`` is the topology that ``grown_shard`` is drawn from (NULL without one). The law is
    ``key``: doc_id and topology decide alone. Rows without a doc_id share the empty key; a
    null text has size 1 and the checksum of no bytes; repeated rows stay, with a slot each.
    Other columns are not read. Slots count from 0 without gaps in each shard: stored rows are
    numbered in runs of ``RUN_ROWS``, and the sums of earlier runs are added, so that no task
    holds a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, _ = stored(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, leaves).alias("shard"),
        (shard_of(key, more) if more else F.lit(None).cast("int")).alias("grown_shard"),
    ), "shards")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_run", F.floor(F.col("_row") / RUN_ROWS))
    run = ["shard", "_file", "_run"]
    before = Window.partitionBy("shard").orderBy("_file", "_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*run).count().select(
        *run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy("_row")) - 1)
    return numbered.join(offsets, run).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_n")).alias("slot"), "grown_shard")
