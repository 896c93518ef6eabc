"""Nearest neighbours by a hash-prefix forest.

Vectors are dealt to blocks of bounded size. In a block each tree is a sorted array of long hash
strings, one sign bit per random plane. A query descends every tree to the longest prefix that it
shares with a stored string, then ascends all trees together, one bit at a time, until the ranges
of its prefixes hold enough entries; these are compared exactly. Blocks are searched one by one,
so the work is spread, and every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.common import stored

#: Hash strings per vector, and bits of each.
TREES, BITS = 32, 32
#: Entries that the ranges of all trees hold together when the ascent ends, per vector of the block.
ENTRIES = 0.8
#: Bytes of vectors in a block, of an index and of queries.
BLOCK_BYTES = 4 << 20


def planes(size: int, trees: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, trees * bits))


def strings(vectors: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as numbers, first bit highest (trees x vectors)."""
    signs = (vectors @ planes(vectors.shape[1], trees, bits) > 0).reshape(len(vectors), trees, bits)
    return (signs @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))).T.astype(np.uint64)


class Forest:
    """The trees of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sorted_strings: np.ndarray, order: np.ndarray, bits: int = BITS):
        self.ids, self.vectors, self.strings, self.order, self.bits = ids, vectors, sorted_strings, order, bits

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> Forest:
        names = strings(vectors, trees, bits)
        order = np.argsort(names, axis=1, kind="stable")
        return cls(ids, vectors, np.take_along_axis(names, order, axis=1), order.astype(np.int32), bits)

    def ranges(self, queries: np.ndarray, entries: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in each tree (queries x trees) after descent and common ascent."""
        trees, n = self.strings.shape
        names = strings(queries, trees, self.bits)

        def at_depth(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ranges of the prefixes without the last ``cut`` bits of each query."""
            low, high = (np.empty((len(queries), trees), dtype=np.int32) for _ in range(2))
            for t in range(trees):
                first = names[t] >> cut << cut
                low[:, t] = np.searchsorted(self.strings[t], first, side="left")
                high[:, t] = np.searchsorted(self.strings[t], first | ((one << cut) - one), side="right")
            return low, high

        # ranges only grow on the way up: the first depth with enough entries is found by halving
        one, wanted = np.uint64(1), min(entries, n * trees)
        below, enough = np.full(len(queries), -1), np.full(len(queries), self.bits)
        while (enough - below > 1).any():
            middle = (below + enough) // 2
            low, high = at_depth(np.maximum(middle, 0).astype(np.uint64))
            full = (high - low).sum(axis=1) >= wanted
            enough, below = np.where(full, middle, enough), np.where(full, below, middle)
        return at_depth(enough.astype(np.uint64))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, entries: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k nearest found for each query, its own id left out."""
        out, n = [], len(self.ids)
        for a in range(0, len(queries), 512):
            low, high = self.ranges(queries[a:a + 512], max(entries * n, 4 * k))
            for i, (name, query) in enumerate(zip(query_ids[a:a + 512].tolist(), queries[a:a + 512], strict=True)):
                hit = np.zeros(n, dtype=bool)
                for t, (x, y) in enumerate(zip(low[i].tolist(), high[i].tolist(), strict=True)):
                    hit[self.order[t, x:y]] = True
                hit &= self.ids != name
                if hit.sum() < k:  # fewer than wanted: the whole block is at the root
                    hit = self.ids != name
                found = np.flatnonzero(hit)
                scores = np.take(self.vectors, found, axis=0) @ query
                if len(found) > k:
                    least = np.partition(scores, -k)[-k]
                    found = found[scores >= least - 1e-9 * (1 + abs(least))]
                # summed alike wherever a vector stands, so that equal vectors tie
                scores = (self.vectors[found] * query).sum(axis=1)
                best = np.lexsort((self.ids[found], -scores))[:k]
                out.append((name, self.ids[found[best]], scores[best]))
        return out


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and size; of rows with one vec_id the smallest vector."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))


def _packed(rows: DataFrame, block: Column, index: bool, trees: int, bits: int) -> DataFrame:
    """One row per size and block: ids and vectors, and the trees of an index."""
    schema = "size int, block int, ids binary, vectors binary" + (", strings binary, places binary" if index else "")

    def pack(part: pa.Table) -> pa.Table:
        size = part["size"][0].as_py()
        order = np.argsort(part["vec_id"].to_numpy(), kind="stable")
        ids = part["vec_id"].to_numpy()[order]
        vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)[order]
        columns = [[size], [part["block"][0].as_py()], [ids.tobytes()], [vectors.tobytes()]]
        if index:
            forest = Forest.build(ids, vectors, trees, bits)
            columns += [[forest.strings.tobytes()], [forest.order.tobytes()]]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * (len(columns) - 2)
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                        names=[x.split()[0] for x in schema.split(", ")])

    return rows.withColumn("block", block.cast("int")).groupBy("size", "block").applyInArrow(pack, schema)


def build_index(vectors: DataFrame, trees: int = TREES, bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The stored index of all usable vectors, and those vectors (vec_id, vector, size).

    Vectors that are null or zero, or hold null or non-finite components, and rows without a
    vec_id take no part. Vectors of different sizes are indexed apart.
    """
    rows, _ = stored(_usable(vectors), "vectors")
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-8 * total // block_bytes))
    index, _ = stored(_packed(rows, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), True, trees, bits), "forest")
    return index, rows


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, entries: float = ENTRIES, trees: int = TREES,
            bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product) of each query's k nearest found.

    ``queries`` has vec_id, vector and size; a query's own vec_id is no candidate. Equal scores
    go to the smaller vec_id. Blocks of queries are compared with the blocks of their size.
    """
    total = queries.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-8 * total // block_bytes))
    packed = _packed(queries, F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)), False, trees, bits)
    packed = packed.select("size", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    known = index.groupBy("size").agg(F.collect_set("block").alias("known"))  # one number per block
    asked = packed.join(known, "size").withColumn("block", F.explode("known")).drop("known")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                size, ids, vectors, names, places, query_ids, query_vectors = (c[i].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, dtype=np.int64)
                forest = Forest(
                    ids, np.frombuffer(vectors).reshape(-1, size), np.frombuffer(names, dtype=np.uint64).reshape(trees, -1),
                    np.frombuffer(places, dtype=np.int32).reshape(trees, -1), bits)
                found = forest.search(np.frombuffer(query_ids, dtype=np.int64), np.frombuffer(query_vectors).reshape(-1, size), k, entries)
                sizes = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([x[0] for x in found], dtype=np.int64), sizes)),
                    pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))],
                    ["query_id", "vec_id", "score"])

    pairs = index.join(asked, ["size", "block"]).select("size", "ids", "vectors", "strings", "places", "query_ids", "query_vectors")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
