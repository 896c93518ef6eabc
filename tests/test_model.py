import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehold.functions.hashing import feature_seed, seed_vectors, vectors_for
from tracehold.operators import features, gcn, scoring, training
from tracehold.operators.normalize import canonical_logs
from tracehold.plans import jobs
from tracehold.sources import graph_store


def test_seeds(spark):
    texts = ["unknown", "", None, "sshd_x_1001", "12345", "ü" * 1000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    import hashlib
    expected = [int(hashlib.sha256((t or "unknown").encode()).hexdigest(), 16) % 100000 for t in texts]
    assert [r[0] for r in frame.select(feature_seed(F.col("t"))).collect()] == expected
    assert expected[:5] == [76988, 76988, 76988, 22858, 55941]


def test_vectors(spark):
    first = vectors_for(np.array([0]))[0]
    assert np.allclose(first[:4], [0.49625659, 0.7682218, 0.08847743, 0.13203049], atol=1e-7)
    rows = seed_vectors(spark).filter("seed in (0, 99999)").orderBy("seed").collect()
    assert np.array_equal(np.array(rows[0][1:], np.float32), first)
    assert np.array_equal(np.array(rows[1][1:], np.float32), vectors_for(np.array([99999]))[0])


def small_graph(spark, n=12, m=25, seed=0):
    random = np.random.default_rng(seed)
    edges = sorted({tuple(int(v) for v in random.integers(0, n, 2)) for _ in range(m)})
    x = random.uniform(size=(n, 16))
    frame = spark.createDataFrame(
        [(i, *map(float, row)) for i, row in enumerate(x)],
        "idx long, " + ", ".join(f"x{i} double" for i in range(16)))
    return x, edges, frame, spark.createDataFrame(edges, "src long, dst long")


def adjacency(n, edges):
    a = np.zeros((n, n))
    for s, d in edges:
        a[d, s] = 1.0
    np.fill_diagonal(a, 1.0)
    degree = a.sum(axis=1)
    return a / np.sqrt(np.outer(degree, degree))


def numpy_loss(x, p, edges, negatives, w):
    z = p @ (np.maximum(p @ x @ w["W1"] + w["b1"], 0) @ w["W2"]) + w["b2"]
    score = lambda pairs: np.array([z[s] @ z[d] for s, d in pairs])
    soft = lambda v: np.logaddexp(0, v)
    return soft(-score(edges)).mean() + soft(score(negatives)).mean(), z


def test_degree_weights_and_propagation(spark):
    x, edges, nodes, frame = small_graph(spark)
    p = adjacency(12, edges)
    weights = {(r.dst, r.src): r.weight for r in gcn.edge_weights(frame, nodes).collect()}
    assert len(weights) == int((p > 0).sum())
    assert all(abs(p[k] - v) < 1e-12 for k, v in weights.items())
    names = [f"x{i}" for i in range(16)]
    got = np.array([r[1:] for r in gcn.propagate(frame, nodes, names).orderBy("idx").collect()])
    assert np.allclose(got, p @ x)


def test_gradient_matches_finite_differences(spark):
    x, edges, nodes, frame = small_graph(spark)
    p, w = adjacency(12, edges), training.initial_weights(3)
    w["b1"] += 0.05
    w["b2"] -= 0.03
    negatives = [(i, (i * 5 + 3) % 12) for i in range(12)]
    graph = training.prepare(None, frame, nodes)
    assert (graph.n_nodes, graph.n_edges) == (12, len(edges))
    embedded = {r.idx: r for r in training.embed(graph, w).collect()}
    loss, grads = training.gradient(graph, w, spark.createDataFrame(negatives, "src long, dst long"), 12)
    expected, z = numpy_loss(x, p, edges, negatives, w)
    assert np.allclose([[embedded[i][f"z{k}"] for k in range(16)] for i in range(12)], z)
    assert abs(loss - expected) < 1e-9
    random = np.random.default_rng(1)
    for name, value in w.items():
        for _ in range(4):
            at = tuple(random.integers(0, s) for s in value.shape)
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += 1e-6
            up = numpy_loss(x, p, edges, negatives, moved)[0]
            moved[name][at] -= 2e-6
            down = numpy_loss(x, p, edges, negatives, moved)[0]
            assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-5


def test_gradient_with_spread_hot_nodes(spark):
    x, edges, nodes, frame = small_graph(spark)
    w = training.initial_weights(3)
    negatives = spark.createDataFrame([(i, (i * 5 + 3) % 12) for i in range(12)], "src long, dst long")
    graph = training.prepare(None, frame, nodes)
    plain = training.gradient(graph, w, negatives, 12)
    graph = training.prepare(None, frame, nodes, task_rows=1, buckets=5)
    assert graph.edges.hot and graph.edges.table.select("src", "part").distinct().count() > len({s for s, _ in edges})
    spread = training.gradient(graph, w, negatives, 12)
    assert abs(plain[0] - spread[0]) < 1e-9
    assert all(np.allclose(plain[1][k], spread[1][k]) for k in w)


def test_an_epoch_leaves_the_edges_where_they_are(spark):
    x, edges, nodes, frame = small_graph(spark)
    graph = training.prepare(None, frame, nodes, buckets=12)
    embedded = nodes.selectExpr("idx", "1.0D AS scale", *[f"CAST(x{i} AS DOUBLE) AS z{i}" for i in range(16)])
    drawn = spark.range(20).selectExpr("id AS slot", "id % 12 AS src", "id % 7 AS dst")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        with gcn.copartitioned(spark):
            for frame in (training.embed(graph, training.initial_weights(0)), training.score_edges(graph, embedded),
                          graph.edges.spread_sum(embedded, ["z0"], reverse=True), graph.edges.without(drawn)):
                plan = frame._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in plan and "Bucketed: true" in plan
                scans = [k for k, line in enumerate(plan.splitlines()) if "FileScan" in line and "part#" in line and "src#" in line]
                lines, depth = plan.splitlines(), lambda line: len(line) - len(line.lstrip(" :+-*"))
                for scan in scans:  # between the edges and their join there is no exchange
                    above = depth(lines[scan])
                    for line in reversed(lines[:scan]):
                        if depth(line) < above:
                            above = depth(line)
                            assert "Exchange" not in line
                            if "Join" in line:
                                break
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.src, r.dst) for r in graph.edges.without(drawn).collect()) == sorted(
        {(i % 12, i % 7) for i in range(20)} - set(edges) - {(i, i) for i in range(12)})


def test_fit_lowers_loss_and_separates(spark, tmp_path):
    ids = [(f"p{i}", f"cmd{i % 6}") for i in range(40)]
    edges = sorted({(f"p{a}", f"p{(a * 7 + b) % 40}") for a in range(40) for b in (1, 2)})
    nodes = spark.createDataFrame(ids, "id string, cmd_line string")
    index = features.node_index(nodes)
    pairs = features.edge_index(spark.createDataFrame(edges, "src string, dst string"), index)
    path = str(tmp_path / "weights")
    weights, losses = training.fit(index, pairs, epochs=12, rate=0.05, seed=1, weights_path=path)
    assert len(losses) == 12 and np.mean(losses[-3:]) < np.mean(losses[:3])
    stored = graph_store.read_weights(spark, path)
    assert all(np.allclose(stored[k], weights[k]) for k in weights)
    assert {k: v.shape for k, v in stored.items()} == graph_store.weight_shapes()
    assert sum(v.size for v in stored.values()) == 1072
    wide = {k: np.arange(float(np.prod(s))).reshape(s) for k, s in graph_store.weight_shapes(16, 64).items()}
    graph_store.write_weights(spark, wide, path)
    again = graph_store.read_weights(spark, path)
    assert all(again[k].shape == v.shape and (again[k] == v).all() for k, v in wide.items())


@pytest.mark.parametrize("n_nodes,n_samples", [(50, 40), (200, 300), (5, 6), (60, 1200)])
def test_negative_edges(spark, n_nodes, n_samples):
    random = np.random.default_rng(2)
    edges = {tuple(int(v) for v in random.integers(0, n_nodes, 2)) for _ in range(n_samples)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = [tuple(r) for r in gcn.negative_edges(frame, n_nodes, n_samples, "a").collect()]
    assert len(got) == len(set(got)) == n_samples
    assert not set(got) & edges and all(s != d for s, d in got)
    again = {tuple(r) for r in gcn.negative_edges(frame, n_nodes, n_samples, "a").collect()}
    other = {tuple(r) for r in gcn.negative_edges(frame, n_nodes, n_samples, "b").collect()}
    assert again == set(got) and (other != set(got) or n_nodes == 5)


@pytest.mark.parametrize("n_edges,n_samples,expected", [(190, 190, 190), (340, 30, 30), (380, 5, 0), (340, 100, 40), (0, 1000, 380)])
def test_negative_edges_of_dense_graphs(spark, n_edges, n_samples, expected):
    pairs = [(a, b) for a in range(20) for b in range(20) if a != b]
    random = np.random.default_rng(3)
    edges = {pairs[i] for i in random.permutation(len(pairs))[:n_edges]}
    frame = spark.createDataFrame(sorted(edges) + [(1, 1)], "src long, dst long")
    got = [tuple(r) for r in gcn.negative_edges(frame, 20, n_samples).collect()]
    assert len(got) == len(set(got)) == expected
    assert set(got) <= set(pairs) - edges


@pytest.mark.parametrize("n", [0, 1, 17, 99, 500, 501])
def test_smallest_cut(spark, n):
    values = sorted(np.random.default_rng(4).choice(100000, 500, replace=False).tolist())
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    for buckets in (4, 1024):
        cut, kept = gcn.smallest_cut(frame, "v", n, buckets)
        assert kept == min(n, 500)
        assert [v for v in values if v < cut] == values[:kept]


def test_dense_index(spark):
    frame = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("id")).repartition(9)
    rows = [(r.id, r.idx) for r in features.dense_index(frame, ["id"]).collect()]
    assert sorted(rows) == [(v, i) for i, v in enumerate(sorted(v for v, _ in rows))]


def test_train_job(spark, tmp_path):
    nodes = spark.createDataFrame([(f"p{i}", f"c{i}") for i in range(15)], "id string, cmd_line string")
    edges = spark.createDataFrame([(f"p{i}", f"p{(i * 4 + 1) % 15}") for i in range(15)], "src string, dst string")
    weights, losses = jobs.train(nodes, edges, epochs=2)
    assert len(losses) == 2 and weights["W1"].shape == (16, 32)


def test_edges_to_unknown_nodes_drop(spark):
    index = features.node_index(spark.createDataFrame([("a", "x"), ("b", None)], "id string, cmd_line string"))
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("b", "b")], "src string, dst string")
    assert sorted(map(tuple, features.edge_index(edges, index).collect())) == [(0, 1), (1, 1)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(map(tuple, features.known_edges(edges, nodes).collect())) == [("a", "b"), ("b", "b")]


def test_pair_score_is_the_two_node_graph():
    random = np.random.default_rng(0)
    w = training.initial_weights(7)
    w["b1"] += random.normal(size=32) * 0.1
    w["b2"] += random.normal(size=16) * 0.1
    x = random.uniform(size=(2, 16))
    p = adjacency(2, [(0, 1)])
    z = p @ (np.maximum(p @ x @ w["W1"] + w["b1"], 0) @ w["W2"]) + w["b2"]
    expected = 1 - 1 / (1 + np.exp(-(z[0] @ z[1])))
    assert abs(scoring.pair_scores(x[:1], x[1:], w)[0] - expected) < 1e-12


LOG_COLUMNS = "processName string, args string, cmdLine string, userId string, parentProcessId string"


def test_log_scores(spark):
    rows = [("sshd", "x", None, "1001", "12345"), (None, None, None, None, None), ("ls", None, "SYNC", "1", "2"),
            ("TSM", "", "wget", "1", "2"), ("ls", "bash -i", None, "1", "2"), ("ls", "plain", "curl", "1", "2")]
    w = training.initial_weights(1)
    logs = canonical_logs(spark.createDataFrame(rows, LOG_COLUMNS))
    seeds = features.with_seeds(logs).collect()
    assert (seeds[0].parent_seed, seeds[0].child_seed) == (55941, 22858)
    got = scoring.score_logs(logs, w).collect()
    p, c = (np.array([getattr(s, n) for s in seeds]) for n in ("parent_seed", "child_seed"))
    base = scoring.pair_scores(vectors_for(p).astype(float), vectors_for(c).astype(float), w)
    assert np.allclose([r.base_score for r in got], base)
    risky = [True, False, True, True, True, False]
    assert np.allclose([r.score for r in got], [min(0.99, b + 0.9 * k) for b, k in zip(base, risky)])
    alerted = {r.process_name for r in got if r.score > 0.85}
    assert {"sshd", "TSM"} <= alerted
    words = scoring.with_score(logs, F.lit(0.0), whole_words=True).collect()
    assert [r.score for r in words] == [0.9, 0.0, 0.0, 0.9, 0.9, 0.0]


def test_alert_threshold_is_strict_and_lines(spark):
    rows = [("a", "x" * 40, None, "1", "2"), ("b", "", "ignored", "1", "2"), ("c", None, "cmd", "1", "2")]
    logs = canonical_logs(spark.createDataFrame(rows, LOG_COLUMNS))
    scored = logs.withColumn("score", F.when(F.col("process_name") == "a", 0.85).otherwise(0.851))
    assert scored.filter(scoring.is_alert()).count() == 2
    lines = [tuple(r) for r in scoring.alert_lines(scored).collect()]
    assert lines == [("UNKNOWN", "x" * 30, "0.85"), ("UNKNOWN", "unknown", "0.85"), ("UNKNOWN", "cmd", "0.85")]


@pytest.mark.parametrize("n, left, wanted", [(30, 100, 20), (30, 100, 50), (30, 100, 51), (30, 100, 99), (30, 100, 100), (2, 1, 1), (300, 7, 3)])
def test_free_pairs_by_rank(spark, n, left, wanted):
    """Pairs of a nearly complete graph: exactly so many, distinct, free, the same again."""
    random = np.random.default_rng(n + left)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    free = {pairs[i] for i in random.choice(len(pairs), left, replace=False)}
    edges = spark.createDataFrame([p for p in pairs if p not in free] * 2 + [(0, 0)], "src long, dst long")
    got = [(r.src, r.dst) for r in gcn.dense_free_pairs(edges, n, wanted, left, "a").collect()]
    assert len(got) == len(set(got)) == wanted and set(got) <= free
    assert sorted(got) == sorted((r.src, r.dst) for r in gcn.negative_edges(edges, n, wanted, "a").collect())


def test_free_gaps_are_ranked_and_cut_by_blocks(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1), (0, 3), (2, 0), (4, 4)], "src long, dst long")
    taken = {1, 3, 10} | {i * 6 for i in range(5)}
    free = [p for p in range(25) if p not in taken]
    gaps = sorted(tuple(r) for r in gcn.free_gaps(edges, 5).collect())
    assert [p for _, first, length in gaps for p in range(first, first + length)] == free
    assert [rank for rank, _, _ in gaps] == [free.index(first) for _, first, _ in gaps]
    monkeypatch.setattr(gcn, "_RUN", 2)  # many blocks and many listings per gap
    ranks = spark.range(len(free)).selectExpr("id AS rank", "id + 100 AS slot")
    found = gcn.free_by_rank(gcn.free_gaps(edges, 5), ranks, 5, len(free)).collect()
    assert sorted((r.slot - 100, r.src * 5 + r.dst) for r in found) == list(enumerate(free))
    rows = gcn.dense_free_pairs(edges, 5, len(free), len(free)).collect()
    assert sorted(r.src * 5 + r.dst for r in rows) == free
