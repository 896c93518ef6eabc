"""The prefix trie of conversations, as balanced parentheses per shard.

A conversation is a path: 16 bytes of hash per turn, one after another. Distinct paths are sorted and dealt to
shards of consecutive paths. A shard writes its trie as parentheses in preorder; ``findclose`` over a
range min tree of excess blocks gives each node's subtree, ranks of leaf pairs its leaves, and
cumulative arrays its members and tokens. Neighbouring shards share the nodes above their common edge only: these
spines are merged by key, less what was counted on both sides of an edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracehold.llm.common import stored

#: Bytes of a turn's hash.
STEP = 16
#: Turns from which on a shard ends; a longer path is a shard of its own.
SHARD_TURNS = 1 << 19
#: Parentheses in a block of the range min tree.
BLOCK = 64
#: Conversation numbers that are joined to one string before hashing: 2**ENDS_BITS.
ENDS_BITS = 12
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# parentheses

class Excess:
    """Parentheses (+1, -1) with the smallest excess of each block, and of pairs of blocks, level by level."""

    def __init__(self, steps: np.ndarray):
        self.excess = np.cumsum(steps.astype(np.int32), dtype=np.int32)
        top = np.iinfo(np.int32).max
        blocks = max(1, 1 << (-(-len(steps) // BLOCK) - 1).bit_length())
        padded = np.full(blocks * BLOCK, top, dtype=np.int32)
        padded[:len(steps)] = self.excess
        self.padded = padded
        self.levels = [padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from ``at`` to the end of its block with an excess of ``goal`` or less, else -1."""
        out = np.full(len(at), -1, dtype=np.int64)
        open_ = np.arange(len(at))
        place = at.copy()
        while len(open_):
            hit = self.padded[place[open_]] <= goal[open_]
            out[open_[hit]] = place[open_[hit]]
            open_ = open_[~hit]
            place[open_] += 1
            open_ = open_[place[open_] % BLOCK > 0]
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where each of some opening parentheses is closed."""
        goal = self.excess[opens] - 1
        out = np.full(len(opens), -1, dtype=np.int64)
        inside = (opens + 1) % BLOCK > 0
        out[inside] = self._scan(opens[inside] + 1, goal[inside])
        left = np.flatnonzero(out < 0)
        block, level = opens[left] // BLOCK, 0
        found, levels = [], []
        while len(left):  # climb until a block to the right reaches the goal
            right = block + 1
            ok = block % 2 == 0
            ok[ok] = self.levels[level][right[ok]] <= goal[left[ok]]
            found.append((left[ok], right[ok]))
            levels.append(level)
            left, block = left[~ok], block[~ok] // 2
            level += 1
        for (who, block), level in zip(found, levels, strict=True):  # and descend to its first block that does
            while level:
                level -= 1
                block = block * 2
                block = block + (self.levels[level][block] > goal[who])
            out[who] = self._scan(block * BLOCK, goal[who])
        return out


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest value of each range, by tables over powers of two; ranges are not empty."""
    power = np.frexp((end - begin).astype(np.float64))[1] - 1
    out, table = np.empty(len(begin), dtype=np.int64), values
    for k in range(int(power.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = power == k
        out[now] = np.minimum(table[begin[now]], table[end[now] - (1 << k)])
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    n = min(len(a), len(b)) // STEP
    if a[:n * STEP] == b[:n * STEP]:
        return n
    x, y = (np.frombuffer(p, np.uint64, 2 * n).reshape(-1, 2) for p in (a, b))
    return int(np.argmax((x != y).any(axis=1)))


def prefix_keys(path: bytes) -> list[bytes]:
    """SHA-256 of every prefix of a path, the empty one first."""
    digest = hashlib.sha256()
    out = [digest.digest()]
    for at in range(0, len(path), STEP):
        digest.update(path[at:at + STEP])
        out.append(digest.digest())
    return out


def shard_nodes(paths: list[bytes], words: list[np.ndarray], copies: list[int], convs: list[int]) -> dict[str, np.ndarray | list]:
    """The nodes of some distinct paths in ascending order, in preorder: columns by name.

    ``all_tokens`` sums members times words over the subtree, ``tokens`` the words of each of its nodes.
    ``key`` is a node's name if it lies on the first or last path (the spines), ``parent_key`` its parent's.
    ``end`` is the path that ends in a node, or -1.
    """
    lengths = np.array([len(p) // STEP for p in paths], dtype=np.int64)
    shared = np.array([0, *(common_turns(a, b) for a, b in zip(paths[:-1], paths[1:], strict=True))], dtype=np.int64)
    m, opened = len(paths), lengths - shared
    runs = np.zeros(2 * m + 2, dtype=np.int64)
    runs[0], runs[2::2][:m] = 1, opened
    runs[3:-1:2] = lengths[:-1] - shared[1:]
    runs[-1] = lengths[-1] + 1
    steps = np.repeat(np.where(np.arange(2 * m + 2) % 2, -1, 1).astype(np.int8), runs)

    opens = np.flatnonzero(steps > 0)
    closes = Excess(steps).findclose(opens)
    nodes = len(opens)
    order = np.arange(nodes)
    after = _sums(steps > 0)[closes]  # the first node behind each subtree, in preorder
    leaf = np.zeros(len(steps), dtype=bool)
    leaf[:-1] = (steps[:-1] > 0) & (steps[1:] < 0)
    leaves = _sums(leaf)
    ends = np.cumsum(opened)  # the node in which each path ends
    end = np.full(nodes, -1, dtype=np.int64)
    end[ends] = np.arange(m)
    finished = _sums(end >= 0)
    members = np.zeros(nodes, dtype=np.int64)
    members[ends] = copies
    members = _sums(members)
    members = members[after] - members[order]

    depth, own, parent = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64), np.arange(-1, nodes - 1)
    spine, at = np.zeros(int(lengths.max()) + 1, dtype=np.int64), 1
    for path, (a, b) in enumerate(zip(shared.tolist(), lengths.tolist(), strict=True)):
        new = slice(at, at + b - a)
        depth[new] = np.arange(a + 1, b + 1)
        own[new] = words[path][a:b]
        if b > a:
            parent[at] = spine[a]
            spine[a + 1:b + 1] = np.arange(new.start, new.stop)
        at += b - a
    children = np.bincount(parent[1:], minlength=nodes)
    weight, alone = _sums(members * own), _sums(own)

    key: list[bytes | None] = [None] * nodes
    for path, where in ((paths[0], range(int(lengths[0]) + 1)), (paths[-1], spine[:lengths[-1] + 1].tolist())):
        for node, name in zip(where, prefix_keys(path), strict=True):
            key[node] = name
    conv = _smallest(np.array(convs, dtype=np.int64), finished[order], finished[after])
    return {
        "conv_id": conv, "depth": depth, "parent_conv_id": np.append(conv[:1], conv[parent[1:]]), "n_convs": members,
        "n_children": children, "n_leaves": leaves[closes] - leaves[opens], "all_tokens": weight[after] - weight[order],
        "tokens": alone[after] - alone[order], "end": end, "key": key,
        "parent_key": [None, *(key[p] for p in parent[1:].tolist())],
    }


# paths

def turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: hash and words of each turn in order of turn, nulls first, ties by hash."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, STEP).alias("hash"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "hash", "words"))).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation behind the first turns of its group's first one: crc32(conv_id) % heads of them replace its own."""
    first = turns.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head"))
    rows = turns.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn(
        "_n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).join(first, "_base", "left")
    head = F.when(F.col("_head").isNull() | (F.col("_n") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_n")))
    own = F.slice("turns", F.col("_n") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_n")))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, path, words and path_key of every conversation."""
    path = F.aggregate("turns", F.lit("").cast("binary"), lambda x, t: F.concat(x, t["hash"]))
    return turns.select("conv_id", F.transform("turns", lambda t: t["words"]).alias("words"), path.alias("path")).withColumn(
        "path_key", F.unhex(F.sha2("path", 256)))


# shards and spines

_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "all_tokens", "tokens")
_SCHEMA = "part int, shard int, " + ", ".join(f"{c} long" for c in _NODE) + \
    ", end_key binary, key binary, parent_key binary, first binary, last binary, first_words array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((c, pa.int64()) for c in _NODE),
                    *((c, pa.binary()) for c in ("end_key", "key", "parent_key", "first", "last")), ("first_words", pa.list_(pa.int32()))])


def _built(paths: DataFrame, shard_turns: int) -> DataFrame:
    """The nodes of every shard, and one row per shard with its first and last path."""
    def rows(part: int, shard: int, held: list) -> Iterator[pa.RecordBatch]:
        path, words, copies, convs, keys = map(list, zip(*held, strict=True))
        nodes = shard_nodes(path, words, copies, convs)
        n = len(nodes["depth"])
        ends = [keys[e] if e >= 0 else None for e in nodes["end"].tolist()]
        columns = [np.full(n, part, np.int32), np.full(n, shard, np.int32), *(nodes[c] for c in _NODE), ends, nodes["key"], nodes["parent_key"],
                   *[[None] * n] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        edge = [part, shard, *[None] * len(_NODE), None, None, None, path[0], path[-1], words[0]]
        yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(edge, _ARROW, strict=True)], schema=_ARROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, turns = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lists = batch.column(1)
            for path, words, copies, conv, key in zip(
                    batch.column(0).to_pylist(), lists, batch.column(2).to_pylist(), batch.column(3).to_pylist(),
                    batch.column(4).to_pylist(), strict=True):
                if held and turns + len(path) // STEP > shard_turns:
                    yield from rows(part, shard, held)
                    shard, held, turns = shard + 1, [], 0
                held.append((path, np.asarray(words.values), copies, conv, key))
                turns += len(path) // STEP
        if held:
            yield from rows(part, shard, held)

    ordered = paths.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.select("path", "words", "copies", "conv_id", "path_key").mapInArrow(work, _SCHEMA)


_FIX = "key binary, depth long, parent_key binary, n_children long, n_leaves long, tokens long"


def _counted_twice(edges: DataFrame) -> DataFrame:
    """What neighbouring shards have both counted, as negative numbers by node: one row per shared turn of an edge."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for before, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = common_turns(before, path)
                keys = prefix_keys(path[:n * STEP])
                ended = -1 if len(before) == n * STEP else 0  # a leaf to the one side, with children to the other
                left = sum(words[:n])
                for d in range(n + 1):
                    left -= words[d - 2] if d > 1 else 0
                    out.append((keys[d], d, keys[d - 1] if d else None, -1 if d < n else 0, ended, -left))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(
                columns, (pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 3), strict=True)], [x.split()[0] for x in _FIX.split(", ")])

    pairs = edges.select("first", "first_words", F.lag("last").over(Window.orderBy("part", "shard")).alias("before"))
    return pairs.where(F.col("before").isNotNull()).select("before", "first", "first_words").mapInArrow(work, _FIX)


def _ends(paths: DataFrame) -> DataFrame:
    """path_key and ends_sha256 of every distinct path.

    Numbers are joined in runs of 4,096 first; a path's runs are hashed one after another, as
    SHA-256 demands, and none is held.
    """
    runs = paths.groupBy("path_key", F.shiftright("conv_id", ENDS_BITS).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        sums.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(sums, type=pa.string())], ["path_key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], type=pa.binary()), pa.array([digest.hexdigest()])], ["path_key", "ends_sha256"])

    return runs.repartition("path_key").sortWithinPartitions("path_key", "run").select("path_key", "ids").mapInArrow(
        work, "path_key binary, ends_sha256 string")


def trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct leading sequence of turns (``conv_id``, ``turns`` as in ``turn_hashes``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. The root (depth 0) has every conversation, also those without turns. No conversations give no
    rows. Turns are equal if 16 bytes of SHA-256 of role and text are. A conversation's hashes are one
    row, however long it is; its texts are not gathered.
    """
    paths, _ = stored(_paths(turns), "conversation-paths")
    distinct = paths.groupBy("path_key").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("conv_id"))
    once = paths.join(distinct, ["path_key", "conv_id"])
    nodes, _ = stored(_built(once, shard_turns), "trie-shards")
    ends, _ = stored(_ends(paths), "trie-ends")
    inner = nodes.where("depth IS NOT NULL")
    spines = inner.where("key IS NOT NULL")
    sums = ("n_convs", "n_children", "n_leaves", "all_tokens", "tokens")
    fixes = _counted_twice(nodes.where("depth IS NULL"))
    merged = spines.select("key", "depth", "parent_key", "conv_id", *sums, F.col("end_key").isNotNull().cast("int").alias("ended")).unionByName(
        fixes, allowMissingColumns=True).groupBy("key", "depth", "parent_key").agg(
        F.min("conv_id").alias("conv_id"), F.max("ended").alias("ended"), *(F.sum(c).alias(c) for c in sums))
    merged, _ = stored(merged, "trie-spines")

    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_conv"))
    saved = (F.col("all_tokens") - F.col("tokens")).alias("saved_tokens")
    fields = ["depth", "n_convs", "n_children", "n_leaves", saved]
    on_spines = merged.join(names, "parent_key", "left").select(
        "conv_id", F.col("_conv").alias("parent_conv_id"), *fields, F.when(F.col("ended") == 1, F.col("key")).alias("end_key"))
    # below a spine: the parent's number comes back shard by shard, so that no node's children meet in one task
    known = spines.select("part", "shard", F.col("key").alias("parent_key")).join(names, "parent_key")
    others = inner.where("key IS NULL")
    below = others.where("parent_key IS NOT NULL").join(known, ["part", "shard", "parent_key"]).select(
        "conv_id", F.col("_conv").alias("parent_conv_id"), *fields, "end_key")
    deep = others.where("parent_key IS NULL").select("conv_id", "parent_conv_id", *fields, "end_key")
    rows = on_spines.unionByName(below).unionByName(deep)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return rows.where("end_key IS NOT NULL").join(ends.withColumnRenamed("path_key", "end_key"), "end_key").select(
        *columns, "ends_sha256").unionByName(rows.where("end_key IS NULL").select(*columns, F.lit(EMPTY_SHA256).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of all conversations, rebuilt so that groups of 20 share their first turns.

    Null roles and texts are empty. Rows without a conv_id take no part. Turns that tie keep the order of their
    hashes; repeated turns count each. Columns other than conv_id, turn, role and text are not looked at.
    """
    return trie(rebuilt(turn_hashes(conversations)), shard_turns)


#: The query in DuckDB: every prefix of every path by name, and every node with all its ancestors.
ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({'h': h, 'w': len(w)} ORDER BY turn NULLS FIRST, h) AS t FROM turns GROUP BY conv_id
), drawn AS (
  SELECT conv_id, t, CAST(crc AS BIGINT) % 4 AS n FROM (
    SELECT l.conv_id, l.t, (WITH RECURSIVE
      bytes AS (SELECT list_transform(string_split(l.conv_id::VARCHAR, ''), lambda c: ord(c)) AS b),
      steps(i, c) AS (
        SELECT 0, 4294967295::UBIGINT
        UNION ALL
        SELECT i + 1, list_reduce(list_prepend(xor(c, b[i + 1]::UBIGINT), range(8)::UBIGINT[]),
          lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
        FROM steps, bytes WHERE i < len(b))
      SELECT xor(c, 4294967295::UBIGINT) FROM steps ORDER BY i DESC LIMIT 1) AS crc FROM lists l)
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(b.t[1:d.n], []), d.t[d.n + 1:]) AS t
  FROM drawn d LEFT JOIN lists b ON b.conv_id = d.conv_id - d.conv_id % 20
), places AS (
  SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt
), named AS (
  SELECT conv_id, d, len(t) AS n, CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w,
    list_transform(range(0, d + 1), lambda k: sha256(array_to_string(list_transform(t[1:k], lambda x: x.h), ','))) AS up FROM places
), nodes AS (
  SELECT up[-1] AS id, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS deepest,
    (count(*) - 1) * any_value(w) AS saved, string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM named GROUP BY up[-1]
), above AS (
  SELECT saved, deepest = depth AS leaf, depth, unnest(up) AS id, unnest(range(0, depth + 1)) AS lvl FROM nodes
), sums AS (
  SELECT id, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE depth = lvl + 1) AS n_children
  FROM above GROUP BY id
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.id = n.id LEFT JOIN nodes p ON n.depth > 0 AND p.id = n.up[-2]
"""
