"""Fit the two-layer graph autoencoder with distributed full-batch gradients.

Each epoch works on static tables: nodes with propagated features, and edges that stay in the
parts they are stored in, to which values are sent (``gcn.PartedEdges``). The driver holds only the 1,072 weights. Propagation
is linear, so both forward and backward passes move 16 columns per node:

    Z  = P (relu(AX W1 + b1) W2) + b2      AX = P X, computed once
    Q  = P' dZ                             one reversed propagation
    dW2 = H' Q,  dH = Q W2',  dW1 = AX' (dH * [S > 0]),  db2 = sum dZ

Every epoch starts from the stored tables and the weights, so lineage does not
grow and nothing needs to be checkpointed per epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tracehold.functions import fixed_values as fv
from tracehold.functions.numeric import bce_with_logits, sigmoid
from tracehold.operators import gcn
from tracehold.operators.features import node_features
from tracehold.operators.skew import TASK_ROWS, join_ends, lookup
from tracehold.session import materialize
from tracehold.sources.graph_store import weight_shapes, write_weights

Weights = dict[str, np.ndarray]


def initial_weights(seed: int = 0, inputs: int = fv.FEATURE_WIDTH, hidden: int = fv.HIDDEN_WIDTH) -> Weights:
    """Glorot-uniform matrices and zero biases."""
    random = np.random.default_rng(seed)
    weights = {}
    for name, shape in weight_shapes(inputs, hidden).items():
        if len(shape) == 2:
            bound = np.sqrt(6.0 / sum(shape))
            weights[name] = random.uniform(-bound, bound, shape)
        else:
            weights[name] = np.zeros(shape)
    return weights


@dataclass
class TrainingGraph:
    """The static tables of a fit."""

    nodes: DataFrame  # idx, scale = 1/sqrt(degree), a0.. = propagated features
    edges: gcn.PartedEdges  # all edges as given, in parts that stay in place
    n_nodes: int
    n_edges: int
    inputs: int

    @property
    def all_edges(self) -> DataFrame:
        """(src, dst): the positive pairs."""
        return self.edges.table.select("src", "dst")


def prepare(
    index: DataFrame, edges: DataFrame, features: DataFrame | None = None, task_rows: int = TASK_ROWS, buckets: int | None = None
) -> TrainingGraph:
    """Propagate the features once and store the static tables."""
    features = node_features(index) if features is None else features
    features = materialize(features, "fit-features")
    names = [c for c in features.columns if c != "idx"]
    parted = gcn.part_edges(edges, features, task_rows, buckets)
    plain = parted.table.select("src", "dst")
    degree = gcn.in_degree(plain, features)
    spread = gcn.propagate(plain, features, names)
    nodes = materialize(
        spread.join(degree, "idx").select(
            "idx",
            (1.0 / F.sqrt("degree")).alias("scale"),
            *[F.col(n).alias(f"a{i}") for i, n in enumerate(names)],
        ),
        "fit-nodes",
    )
    parted.routes = materialize(parted.routes.join(nodes.select("idx", "scale"), "idx"), "edge-routes")
    return TrainingGraph(nodes=nodes, edges=parted, n_nodes=nodes.count(), n_edges=plain.count(), inputs=len(names))


def _hidden_out(nodes: DataFrame, weights: Weights, inputs: int) -> DataFrame:
    """(idx, scale, g0.., o0..): relu(AX W1 + b1) W2 scaled for sending, and the
    node's own part with the output bias. Row-local numpy.

    The bias goes in here rather than as literals of the plan, so the plan of
    every epoch is the same and its generated code is compiled once.
    """
    w1, b1, w2, b2 = (weights[n] for n in ("W1", "b1", "W2", "b2"))
    a = gcn.columns("a", inputs)
    out_columns = gcn.columns("g", w2.shape[1]) + gcn.columns("o", w2.shape[1])

    def layer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[a].to_numpy()
            scale = batch["scale"].to_numpy()
            sent = np.maximum(x @ w1 + b1, 0.0) @ w2 * scale[:, None]
            own = sent + b2 / scale[:, None]
            out = pd.DataFrame(np.hstack([sent, own]), columns=out_columns)
            out.insert(0, "scale", scale)
            out.insert(0, "idx", batch["idx"].to_numpy())
            yield out

    schema = "idx long, scale double, " + ", ".join(f"{c} double" for c in out_columns)
    return nodes.mapInPandas(layer, schema)


def embed(graph: TrainingGraph, weights: Weights) -> DataFrame:
    """(idx, scale, z0..): node embeddings under the weights."""
    width = weights["W2"].shape[1]
    g, o, z = (gcn.columns(p, width) for p in "goz")
    out = _hidden_out(graph.nodes, weights, graph.inputs)
    sums = graph.edges.spread_sum(out, g, own=o, carry=["scale"])
    return sums.selectExpr("idx", "scale", *[f"{a} * scale AS {b}" for a, b in zip(g, z)])


def _dot(width: int) -> str:
    s, t = gcn.columns("s", width), gcn.columns("t", width)
    return " + ".join(f"{a} * {b}" for a, b in zip(s, t)) + " AS score"


def score_pairs(graph: TrainingGraph, embedded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add both endpoint embeddings (s0.., t0..) and their dot product to (src, dst, y) pairs."""
    width = sum(c.startswith("z") for c in embedded.columns)
    z, s, t = (gcn.columns(p, width) for p in "zst")
    left = embedded.selectExpr("idx AS _s", *[f"{c} AS {n}" for c, n in zip(z, s)])
    right = embedded.selectExpr("idx AS _t", *[f"{c} AS {n}" for c, n in zip(z, t)])
    return join_ends(pairs, left, "_s", right, "_t").selectExpr("src", "dst", "y", *s, *t, _dot(width))


def score_edges(graph: TrainingGraph, embedded: DataFrame) -> DataFrame:
    """``score_pairs`` of all edges (y = 1): the embeddings come to the edges."""
    width = sum(c.startswith("z") for c in embedded.columns)
    z, s, t = (gcn.columns(p, width) for p in "zst")
    one = graph.edges.with_ends(graph.edges.table, embedded, "src", dict(zip(z, s)))
    both = graph.edges.with_ends(one, embedded, "dst", dict(zip(z, t)))
    return both.selectExpr("src", "dst", "1.0D AS y", *s, *t, _dot(width))


def _score_drawn(embedded: DataFrame, pairs: DataFrame) -> DataFrame:
    """``score_pairs`` of drawn pairs (y = 0); no node is drawn so often as to need spreading."""
    width = sum(c.startswith("z") for c in embedded.columns)
    z, s, t = (gcn.columns(p, width) for p in "zst")
    left = embedded.selectExpr("idx AS _s", *[f"{c} AS {n}" for c, n in zip(z, s)])
    right = embedded.selectExpr("idx AS _t", *[f"{c} AS {n}" for c, n in zip(z, t)])
    one = lookup(pairs.select("src", "dst"), "src", left, "_s", "inner", {})
    return lookup(one, "dst", right, "_t", "inner", {}).selectExpr("src", "dst", "0.0D AS y", *s, *t, _dot(width))


def _embedding_gradient(scored: DataFrame, n_positive: int, n_negative: int, width: int) -> DataFrame:
    """(idx, d0.., loss): gradient of the loss by each node's embedding."""
    size = F.when(F.col("y") == 1.0, float(max(n_positive, 1))).otherwise(float(max(n_negative, 1)))
    pulled = scored.withColumns({
        "pull": (sigmoid(F.col("score")) - F.col("y")) / size,
        "part": bce_with_logits(F.col("score"), F.col("y")) / size,
    })
    d = gcn.columns("d", width)

    def end(key: str, other: str, part: str) -> str:
        pulls = ", ".join(f"pull * {other}{i} AS {c}" for i, c in enumerate(d))
        return f"struct({key} AS idx, {pulls}, {part} AS loss)"

    ends = pulled.selectExpr(
        f"inline(array({end('src', 't', 'part')}, {end('dst', 's', '0.0D')}))"
    )
    return ends.groupBy("idx").agg(*[F.expr(f"sum({c}) AS {c}") for c in (*d, "loss")])


def _weight_gradient(rows: DataFrame, weights: Weights, inputs: int) -> DataFrame:
    """(at, value): the summed gradient entries of all weights, and the loss, by position."""
    w1, b1, w2 = weights["W1"], weights["b1"], weights["W2"]
    a = gcn.columns("a", inputs)
    q, d = gcn.columns("q", w2.shape[1]), gcn.columns("d", w2.shape[1])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x, back = batch[a].to_numpy(), batch[q].to_numpy() * batch[["scale"]].to_numpy()
            s = x @ w1 + b1
            ds = (back @ w2.T) * (s > 0)
            parts = np.concatenate([
                (x.T @ ds).ravel(),
                ds.sum(axis=0),
                (np.maximum(s, 0.0).T @ back).ravel(),
                batch[d].to_numpy().sum(axis=0),
                [batch["loss"].sum()],
            ])
            total = parts if total is None else total + parts
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    return rows.mapInPandas(partial, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")
    )


def gradient(graph: TrainingGraph, weights: Weights, negatives: DataFrame, n_negative: int) -> tuple[float, Weights]:
    """Loss and weight gradients of one full batch. Collects 1,073 numbers."""
    width = weights["W2"].shape[1]
    d, q = gcn.columns("d", width), gcn.columns("q", width)
    routed = embed(graph, weights).drop("scale").join(graph.edges.routes, "idx")
    embedded = routed.persist(StorageLevel.MEMORY_AND_DISK)
    scored = score_edges(graph, embedded).unionAll(_score_drawn(embedded, negatives))
    by_node = _embedding_gradient(scored, graph.n_edges, n_negative, width)
    scaled = by_node.join(graph.edges.routes, "idx").selectExpr(
        "idx", "dst_parts", "loss", *d, *[f"{c} * scale AS {n}" for c, n in zip(d, q)]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    back = graph.edges.spread_sum(scaled, q, reverse=True, carry=[*d, "loss"])
    entries = _weight_gradient(back.join(graph.nodes, "idx"), weights, graph.inputs).collect()
    scaled.unpersist()
    embedded.unpersist()
    flat = np.zeros(sum(w.size for w in weights.values()) + 1)
    for row in entries:
        flat[row["at"]] = row["value"]
    grads, start = {}, 0
    for name, value in weights.items():
        grads[name] = flat[start:start + value.size].reshape(value.shape)
        start += value.size
    return float(flat[-1]), grads


@dataclass
class Adam:
    """Adam step on the driver over the 1,072 weights."""

    rate: float = fv.LEARNING_RATE
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    step: int = 0
    mean: Weights = field(default_factory=dict)
    square: Weights = field(default_factory=dict)

    def update(self, weights: Weights, grads: Weights) -> Weights:
        self.step += 1
        new = {}
        for name, g in grads.items():
            m = self.mean[name] = self.beta1 * self.mean.get(name, 0.0) + (1 - self.beta1) * g
            v = self.square[name] = self.beta2 * self.square.get(name, 0.0) + (1 - self.beta2) * g * g
            m_hat = m / (1 - self.beta1**self.step)
            v_hat = v / (1 - self.beta2**self.step)
            new[name] = weights[name] - self.rate * m_hat / (np.sqrt(v_hat) + self.epsilon)
        return new


def fit(
    index: DataFrame,
    edges: DataFrame,
    epochs: int = fv.EPOCHS,
    rate: float = fv.LEARNING_RATE,
    hidden: int = fv.HIDDEN_WIDTH,
    seed: int = 0,
    weights: Weights | None = None,
    weights_path: str | None = None,
    on_epoch: Callable[[int, float], None] | None = None,
) -> tuple[Weights, list[float]]:
    """Train on graph edges against fresh random non-edges each epoch.

    ``index`` is (id, idx, seed), ``edges`` (src, dst) over ``idx``. Returns the
    weights and the loss of every epoch; ``weights_path`` also stores the
    weights after each tenth epoch and at the end.
    """
    spark = index.sparkSession
    with gcn.copartitioned(spark):
        graph = prepare(index, edges)
        weights = initial_weights(seed, graph.inputs, hidden) if weights is None else weights
        adam, losses = Adam(rate=rate), []
        free = gcn.free_pairs(graph.all_edges, graph.n_nodes)
        for epoch in range(1, epochs + 1):
            drawn, wanted = gcn.enough_pairs(
                graph.all_edges, graph.n_nodes, graph.n_edges, f"{seed}:{epoch}", free, graph.edges.without)
            cut, n_negative = gcn.smallest_cut(drawn, "slot", wanted)
            negatives = drawn.filter(F.col("slot") < cut)
            loss, grads = gradient(graph, weights, negatives, n_negative)
            weights = adam.update(weights, grads)
            losses.append(loss)
            if on_epoch:
                on_epoch(epoch, loss)
            if weights_path and (epoch % 10 == 0 or epoch == epochs):
                write_weights(spark, weights, weights_path)
    return weights, losses
