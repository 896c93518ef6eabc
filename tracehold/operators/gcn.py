"""Graph-convolution steps and edge decoding as joins and aggregations.

Nodes are (idx, columns...), edges are (src, dst) over node numbers. Vectors are
plain double columns, so sums run in generated code and combine map-side: a node
with a third of all edges costs its reducer one row per map task. On the join
side hot nodes are spread by ``lookup``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehold.functions.hashing import draw
from tracehold.functions.numeric import bce_with_logits, dot, sigmoid
from tracehold.functions.text import once
from tracehold.operators.features import dense_index
from tracehold.operators.skew import TASK_ROWS, hot_keys, join_ends, lookup
from tracehold.session import materialize, new_folder


def columns(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(width)]


def loopless(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges plus exactly one self-loop per node."""
    own = nodes.select(F.col("idx").alias("src"), F.col("idx").alias("dst"))
    return loopless(edges).select("src", "dst").unionAll(own)


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(idx, degree): incoming edges of each node, its self-loop included."""
    return (
        with_self_loops(edges, nodes).groupBy(F.col("dst").alias("idx"))
        .agg(F.count("*").alias("degree"))
    )


def edge_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight): the normalised adjacency, self-loops included."""
    degree = in_degree(edges, nodes)
    source = degree.select(F.col("idx").alias("_s"), F.col("degree").alias("_ds"))
    target = degree.select(F.col("idx").alias("_t"), F.col("degree").alias("_dt"))
    weight = 1.0 / F.sqrt(F.col("_ds") * F.col("_dt"))
    return join_ends(with_self_loops(edges, nodes), source, "_s", target, "_t").select(
        "src", "dst", weight.alias("weight")
    )


def spread_sum(
    edges: DataFrame,
    values: DataFrame,
    names: Sequence[str],
    hot: dict | None,
    reverse: bool = False,
    own: Sequence[str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Sum the values of each node's in-neighbours and its own: (idx, names..., carry...).

    ``edges`` are loopless. One join and one aggregation; self-loops need no
    join, they are the value rows themselves (or the ``own`` columns in their
    place). ``carry`` columns are summed over the node's own row only. ``reverse`` sends values against the edges.
    ``hot`` are the hot sending nodes, counted here if None.
    """
    sender, receiver = ("dst", "src") if reverse else ("src", "dst")
    table = values.selectExpr("idx AS _n", *names)
    sent = lookup(edges.select(sender, receiver), sender, table, "_n", "inner", hot).selectExpr(
        f"{receiver} AS idx", *names, *[f"0.0D AS {c}" for c in carry]
    )
    return _received(sent, values, names, own, carry)


def _received(
    sent: DataFrame, values: DataFrame, names: Sequence[str], own: Sequence[str] | None, carry: Sequence[str]
) -> DataFrame:
    """Sums of what nodes are sent and of their own rows."""
    kept = values.selectExpr(
        "idx", *[f"{o} AS {n}" for o, n in zip(own or names, names)], *carry
    )
    sums = [F.expr(f"sum({c}) AS {c}") for c in (*names, *carry)]
    return sent.unionAll(kept).groupBy("idx").agg(*sums)


def propagate(edges: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """One propagation round with the normalised adjacency: (idx, names...).

    The weight 1/sqrt(d_src * d_dst) factors into the two ends, so edges carry
    no weights: values are scaled before sending and after summing.
    """
    straight = loopless(edges).select("src", "dst")
    scale = 1.0 / F.sqrt(F.col("degree"))
    scaled = values.join(in_degree(edges, values), "idx").select(
        "idx",
        scale.alias("_scale"),
        *[(F.col(c).cast("double") * scale).alias(c) for c in names],
    )
    sums = spread_sum(straight, scaled, names, None, carry=["_scale"])
    return sums.select("idx", *[(F.col(c) * F.col("_scale")).alias(c) for c in names])


# edges that stay where they are: a part per source, and values sent to the parts that ask for them


@contextmanager
def copartitioned(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile may join on (part, node) rows that lie by part alone, without dealing them anew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class PartedEdges:
    """Edges stored in buckets of ``part``, and for each node the parts that hold it as a source or target.

    All edges of a source lie in one part, those of a hot source (``hot``: tasks by node) in several. A
    round sends each node's values to its parts, at most ``parts`` copies, and the edges are read in place.
    """

    table: DataFrame  # part, src, dst
    routes: DataFrame  # idx, src_parts, dst_parts
    parts: int
    buckets: int
    hot: dict

    @property
    def straight(self) -> DataFrame:
        return loopless(self.table)

    def placed(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the part that an edge of that kind lies in, dealt by it."""
        return _with_part(pairs, self.parts, self.hot).repartition(self.buckets, "part")

    def sent(self, values: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
        """(_part, _n, names): values of nodes at the parts that hold them as ``end``.

        Values that have the columns of ``routes`` already are not joined with them.
        """
        if f"{end}_parts" not in values.columns:
            values = values.join(self.routes.select("idx", f"{end}_parts"), "idx")
        return values.selectExpr(
            f"explode({end}_parts) AS _part", "idx AS _n", *[f"{c} AS {n}" for c, n in names.items()])

    def with_ends(self, edges: DataFrame, values: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
        """Edges with the values of one end under new names."""
        rows = self.sent(values, end, names)
        return edges.join(rows, (F.col("part") == F.col("_part")) & (F.col(end) == F.col("_n"))).drop("_part", "_n")

    def spread_sum(self, values: DataFrame, names: Sequence[str], reverse: bool = False,
                   own: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """``spread_sum`` of this module over these edges without their loops."""
        sender, receiver = ("dst", "src") if reverse else ("src", "dst")
        moved = self.with_ends(self.straight, values, sender, {c: c for c in names}).selectExpr(
            f"{receiver} AS idx", *names, *[f"0.0D AS {c}" for c in carry])
        return _received(moved, values, names, own, carry)

    def without(self, drawn: DataFrame) -> DataFrame:
        """(slot, src, dst): distinct drawn pairs that are no edge and no self-pair, each with its lowest slot."""
        pairs = self.placed(loopless(drawn)).groupBy("part", "src", "dst").agg(F.min("slot").alias("slot"))
        return pairs.join(self.table, ["part", "src", "dst"], "left_anti").select("slot", "src", "dst")


def _with_part(pairs: DataFrame, parts: int, hot: dict) -> DataFrame:
    salt = F.lit(0).cast("long")
    if hot:
        known = F.broadcast(pairs.sparkSession.createDataFrame(list(hot.items()), "_hot long, _tasks int"))
        pairs = pairs.join(known, F.col("src") == F.col("_hot"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_tasks").cast("long")), salt)
    part = F.pmod(F.xxhash64("src", salt), F.lit(parts)).cast("int")
    return pairs.withColumn("part", part).drop("_hot", "_tasks")


def part_edges(edges: DataFrame, nodes: DataFrame, task_rows: int = TASK_ROWS, buckets: int | None = None) -> PartedEdges:
    """Store (src, dst) edges by part. Moves them once; a bucket is a task of every later round.

    ``buckets`` is the number of shuffle partitions at least (the planner would deal fewer anew); a part is a
    quarter of a bucket.
    """
    spark = edges.sparkSession
    buckets = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, hot = 4 * buckets, hot_keys(edges, "src", task_rows)
    name = f"tracehold_edges_{uuid.uuid4().hex}"
    rows = _with_part(edges.select("src", "dst"), parts, hot).select("part", "src", "dst")
    rows.repartition(buckets, "part").write.bucketBy(buckets, "part").option("path", new_folder(spark, "parted-edges")).saveAsTable(name)
    table = spark.table(name)
    routes = nodes.select("idx")
    for end in ("src", "dst"):
        held = table.groupBy(F.col(end).alias("idx")).agg(F.collect_set("part").alias(f"{end}_parts"))
        routes = routes.join(held, "idx", "left")
    none = F.array().cast("array<int>")
    routes = routes.select("idx", *[F.coalesce(f"{end}_parts", none).alias(f"{end}_parts") for end in ("src", "dst")])
    return PartedEdges(table, materialize(routes, "edge-routes"), parts, buckets, hot)


def edge_scores(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Add ``score`` (dot product of endpoint vectors) and ``anomaly`` to (src, dst) pairs."""
    source = vectors.select(F.col(key).alias("_s"), F.col(vector).alias("_vs"))
    target = vectors.select(F.col(key).alias("_d"), F.col(vector).alias("_vd"))
    both = join_ends(pairs, source, "_s", target, "_d")
    return both.select(
        *pairs.columns, once(dot(F.col("_vs"), F.col("_vd"))).alias("score")
    ).withColumn("anomaly", 1.0 - sigmoid(F.col("score")))


def labelled_edges(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(src, dst, y): graph edges with 1.0 and sampled non-edges with 0.0."""
    return positive.select("src", "dst", F.lit(1.0).alias("y")).unionAll(
        negative.select("src", "dst", F.lit(0.0).alias("y"))
    )


def mean_bce(scored: DataFrame) -> DataFrame:
    """One row: mean loss over the edges, over the non-edges, and their sum."""
    loss = bce_with_logits(F.col("score"), F.col("y"))

    def mean_of(label: float):
        return F.coalesce(F.avg(F.when(F.col("y") == label, loss)), F.lit(0.0))

    return scored.agg(
        mean_of(1.0).alias("edge_loss"), mean_of(0.0).alias("non_edge_loss")
    ).withColumn("loss", F.col("edge_loss") + F.col("non_edge_loss"))


def free_pairs(edges: DataFrame, n_nodes: int) -> int:
    """Number of ordered pairs of different nodes that are no edge."""
    return n_nodes * (n_nodes - 1) - loopless(edges).select("src", "dst").distinct().count()


def _without_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.filter(F.col("src") != F.col("dst")).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def drawn_pairs(
    edges: DataFrame, n_nodes: int, slots: int, label: str = "0", without: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(slot, src, dst): distinct random pairs that are no edge and no self-pair.

    Pairs are hashes of a label and a slot number, so a retried task draws the
    same pairs; a pair drawn repeatedly has its lowest slot. ``without`` leaves out edges and self-pairs
    (``PartedEdges.without``); by default a join with ``edges`` does.
    """
    n = F.lit(n_nodes)
    drawn = edges.sparkSession.range(slots).select(
        F.col("id").alias("slot"),
        draw(f"{label}:src", F.col("id"), n).alias("src"),
        draw(f"{label}:dst", F.col("id"), n).alias("dst"),
    )
    if without is not None:
        return without(drawn)
    return _without_edges(drawn.groupBy("src", "dst").agg(F.min("slot").alias("slot")), edges)


#: Numbers that are listed from one row at a time, and that a block of ranks holds at most.
_RUN = 1 << 16


def free_gaps(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(rank, first, length): the runs of free pairs, stored.

    The pair (src, dst) has the number ``src * n_nodes + dst``. Taken are edges and self-pairs. Below the i-th
    taken number k (from 0) there are ``k - i`` free ones, so one range sort of the taken numbers tells the rank at which
    each gap begins. As the last number is a self-pair, every gap stands before a taken number.
    """
    number = (F.col("src") * F.lit(n_nodes).cast("long") + F.col("dst")).alias("number")
    own = edges.sparkSession.range(n_nodes).select((F.col("id") * F.lit(n_nodes + 1).cast("long")).alias("number"))
    taken = loopless(edges).select(number).unionAll(own).distinct()
    order = dense_index(taken, ["number"], "i")
    after = order.select((F.col("i") - 1).alias("i"), F.col("number").alias("_next"))
    gaps = order.join(after, "i").filter(F.col("_next") - F.col("number") > 1).select(
        (F.col("number") - F.col("i")).alias("rank"),
        (F.col("number") + 1).alias("first"),
        (F.col("_next") - F.col("number") - 1).alias("length"),
    )
    return materialize(gaps, "free-gaps")


def _counted(frame: DataFrame, count: str, name: str) -> DataFrame:
    """Each row once per number 0 .. count - 1; no row lists more than ``_RUN`` numbers at once."""
    runs = frame.selectExpr("*", f"{count} AS _count").selectExpr("*", f"explode(sequence(0L, (_count - 1) div {_RUN})) AS _run")
    numbers = f"sequence(_run * {_RUN}, least(_run * {_RUN} + {_RUN}, _count) - 1)"
    return runs.selectExpr("*", f"explode({numbers}) AS {name}").drop("_count", "_run")


def _pairs(numbered: DataFrame, n_nodes: int) -> DataFrame:
    return numbered.selectExpr("slot", f"_number div {n_nodes} AS src", f"_number % {n_nodes}L AS dst")


def free_by_rank(gaps: DataFrame, ranks: DataFrame, n_nodes: int, free: int) -> DataFrame:
    """(slot, src, dst) of distinct (rank, slot) rows: the free pair at each rank.

    Gaps and ranks meet by blocks of ranks. A block is about as long as the mean gap, so a rank is compared with about
    one gap, and gaps are cut into at most twice as many pieces (or one per ``_RUN`` ranks).
    """
    width = max(1, min(_RUN, -(-free // max(1, gaps.count()))))
    pieces = gaps.withColumnRenamed("rank", "_rank").selectExpr(
        "*", f"_rank div {width} AS _low", f"(_rank + length - 1) div {width} AS _high")
    pieces = _counted(pieces, "_high - _low + 1", "_at").selectExpr("_low + _at AS _block", "_rank", "first", "length")
    found = ranks.selectExpr("*", f"rank div {width} AS _block").join(pieces, "_block").filter(
        (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("length")))
    return _pairs(found.selectExpr("slot", "first + rank - _rank AS _number"), n_nodes)


def drawn_ranks(spark: SparkSession, free: int, wanted: int, label: str) -> DataFrame:
    """(rank, slot): exactly ``wanted`` different numbers below ``free``, those of the lowest slots.

    Meant for at most half of them; a number drawn repeatedly has its lowest slot.
    """
    slots = int(-free * math.log1p(-1.1 * wanted / free)) + 64
    while True:
        numbers = spark.range(slots).select(
            draw(f"{label}:rank", F.col("id"), F.lit(free)).alias("rank"), F.col("id").alias("slot"))
        drawn = materialize(numbers.groupBy("rank").agg(F.min("slot").alias("slot")), "drawn-ranks")
        if drawn.count() >= wanted:
            cut, _ = smallest_cut(drawn, "slot", wanted)
            return drawn.filter(F.col("slot") < cut)
        slots *= 2


def dense_free_pairs(edges: DataFrame, n_nodes: int, wanted: int, free: int, label: str = "0") -> DataFrame:
    """(slot, src, dst): exactly ``wanted`` (1 to ``free``) pairs that are no edge and no self-pair.

    Up to half of the free pairs are drawn by their ranks. Of more, the ranks to leave out are drawn and the others listed.
    No pair is tried in vain: the cost follows the edges and the wanted pairs.
    """
    if free > 1 << 52:
        raise ValueError("ranks are drawn from 52 bits; a graph with more free pairs is not dense")
    spark, gaps = edges.sparkSession, free_gaps(edges, n_nodes)
    if 2 * wanted <= free:
        return free_by_rank(gaps, drawn_ranks(spark, free, wanted, label), n_nodes, free)
    listed = _counted(gaps, "length", "_at").selectExpr("rank + _at AS slot", "first + _at AS _number")
    if wanted < free:
        left_out = drawn_ranks(spark, free, free - wanted, label).select(F.col("rank").alias("slot"))
        listed = listed.join(left_out, "slot", "left_anti")
    return _pairs(listed, n_nodes)


def enough_pairs(
    edges: DataFrame, n_nodes: int, n_samples: int, label: str = "0", free: int | None = None,
    without: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, int]:
    """Stored (slot, src, dst) rows that hold at least min(``n_samples``, free pairs) pairs, and that number.

    As many slots are drawn as are expected to reach a tenth more than wanted, and twice as many
    where they did not. Where most pairs are edges, or about half of the free ones are wanted, most draws would
    be in vain: there free pairs are taken by rank (``dense_free_pairs``). ``free`` is ``free_pairs``, counted here
    if not given.
    """
    free = free_pairs(edges, n_nodes) if free is None else free
    wanted = min(n_samples, free)
    if wanted <= 0:
        return materialize(drawn_pairs(edges, max(n_nodes, 1), 0, label), "drawn-pairs"), 0
    total = n_nodes * n_nodes
    share = wanted / free
    if 1.1 * share < 0.5 and 2 * free >= total:
        slots = int(-total * math.log1p(-1.1 * share)) + 64
        while slots < 2 * total:
            drawn = materialize(drawn_pairs(edges, n_nodes, slots, label, without), "drawn-pairs")
            if drawn.count() >= wanted:
                return drawn, wanted
            slots *= 2
    return materialize(dense_free_pairs(edges, n_nodes, wanted, free, label), "free-pairs"), wanted


def smallest_cut(frame: DataFrame, column: str, n: int, buckets: int = 1024) -> tuple[int, int]:
    """(cut, kept): exactly ``kept`` = min(n, rows) rows have ``column`` < ``cut``.

    The column holds distinct whole numbers. The cut is narrowed by counting
    rows per value range, a few hundred counts at a time, so no task ever sorts
    or holds all rows.
    """
    low, high, total = frame.agg(F.min(column), F.max(column), F.count("*")).first()
    if total == 0 or n <= 0:
        return (0 if total == 0 else low), 0
    if total <= n:
        return high + 1, total
    start, end, below = low, high + 1, 0
    while end - start > 1:
        width = -(-(end - start) // buckets)
        inside = (F.col(column) >= start) & (F.col(column) < end)
        bucket = F.floor((F.col(column) - start) / width).cast("long")
        counts = dict(
            frame.filter(inside).groupBy(bucket.alias("b")).agg(F.count("*")).collect()
        )
        for at in sorted(counts):
            if below + counts[at] >= n:
                break
            below += counts[at]
        start, end = start + at * width, min(start + (at + 1) * width, end)
        if below + counts[at] == n:
            return end, n
    return end, n


def negative_edges(edges: DataFrame, n_nodes: int, n_samples: int, label: str = "0") -> DataFrame:
    """(src, dst): distinct random pairs that are no edge and no self-pair.

    Exactly ``n_samples`` of them, or all there are: the lowest slots of ``enough_pairs``.
    """
    pairs, wanted = enough_pairs(edges, n_nodes, n_samples, label)
    cut, _ = smallest_cut(pairs, "slot", wanted)
    return pairs.filter(F.col("slot") < cut).select("src", "dst")
