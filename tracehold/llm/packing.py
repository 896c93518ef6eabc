"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import stored
from tracehold.llm.tokens import closed, encoder, id_lists, tokenizer_file

#: Pieces that one task packs: many enough that the open bins left over hardly count.
GROUP_PIECES = 1 << 15
PIECES = "doc_id long, part int, row long, piece int, start long, length long, ids_crc32 long, ids array<int>"


class OpenBins:
    """A segment tree over remaining capacities; finds the tightest open bin in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)  # open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the bin with the least room of at least ``length``."""
        count, node = self.count, length + self.leaves
        while not count[node]:
            while node & 1:  # a right child: nothing to the right of it below this parent
                node >>= 1
                if node <= 1:
                    return None
            node |= 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each length, given in decreasing order."""
    opened, bins, offsets, n = OpenBins(capacity), [], [], 0
    for length in lengths:
        found = opened.take(length)
        if found is None:
            found, n = (capacity, n), n + 1
        room, name = found
        bins.append(name)
        offsets.append(capacity - room)
        if room > length:
            opened.add(room - length, name)
    return bins, offsets


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> tuple[DataFrame, str]:
    """Every text's ids and ``end_id``, cut into pieces of at most ``capacity``; stored, with the path.

    Only longer documents are cut. ``part`` and ``row`` name a piece. Null texts are empty.
    """
    definition = tokenizer_file(documents.sparkSession, tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, row = encoder(definition.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, _, ids, counts in tokens.encode_column(batch.column(1)):
                ids, starts = closed(ids, counts, end_id)
                pieces = -(-np.diff(starts) // capacity)
                owner = np.repeat(np.arange(len(counts)), pieces)
                n = len(owner)
                number = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = starts[owner] + number * capacity
                edges = np.append(first, starts[-1])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(i + owner)), pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(np.arange(row, row + n)), pa.array(number.astype(np.int32)), pa.array(number * capacity),
                    pa.array(np.diff(edges)), pa.array(sums, type=pa.int64()), id_lists(ids, edges),
                ], [x.split()[0] for x in PIECES.split(", ")])
                row += n

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(cut, PIECES), "token-pieces")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The columns of ``pieces`` but ids, and sequence_id and offset of each piece.

    Full pieces are sequences of their own. The others are dealt by a hash of their name to
    groups of about ``GROUP_PIECES``, each packed by best-fit decreasing: equal lengths in the
    order of their names. A group loses a part of one sequence or so against packing all at once.
    """
    rows = pieces.drop("ids")
    short = rows.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP_PIECES))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "part", "row"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].tolist(), capacity)
        frame["sequence_id"] = (np.array(bins, dtype=np.int64) * groups + frame["_group"].to_numpy()) * 2
        frame["offset"] = np.array(offsets, dtype=np.int64)
        return frame.drop(columns="_group")

    short = short.withColumn("_group", F.pmod(F.xxhash64("part", "row"), F.lit(groups)))
    fields = [f.name for f in rows.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    packed = short.groupBy("_group").applyInPandas(fit, f"{schema}, sequence_id long, offset long")
    full = rows.where(F.col("length") == capacity).select(
        *fields, ((F.col("part").cast("long") * F.lit(1 << 36) + F.col("row")) * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of every packed sequence (at most ``capacity`` ids each)."""
    placed = packed.select("part", "row", "sequence_id", "offset").join(pieces.select("part", "row", "ids"), ["part", "row"])
    return placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts")).select(
        "sequence_id", F.flatten(F.transform("_parts", lambda x: x["ids"])).alias("ids"))


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every document's pieces."""
    pieces, _ = token_pieces(documents, tokenizer_path, capacity, end_id)
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
