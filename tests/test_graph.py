import random

import pytest
from pyspark.sql import functions as F

from tracehold.functions import fixed_values as fv
from tracehold.operators import ancestry, graph
from tracehold.operators.normalize import canonical_logs
from tracehold.operators.skew import hot_keys, lookup
from tracehold.plans import jobs
from tracehold.session import new_folder
from tracehold.streaming import jobs as streaming

COLUMNS = "pos long, processId string, parentProcessId string, threadId string, args string, processName string, " \
          "cmdLine string, userId string, is_evil int, event_type string, file_path string, remote_ip string, " \
          "remote_port string, timestamp_ns long, timestamp double"


def logs_of(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(",")]
    full = [tuple({"pos": i, **row}.get(n.strip()) for n in names) for i, row in enumerate(rows)]
    return canonical_logs(spark.createDataFrame(full, COLUMNS), keep=("pos",))


def pairs(frame):
    return {tuple(row) for row in frame.collect()}


ROWS = [
    dict(processId="2", parentProcessId="1", args="first"),
    dict(processId="2", parentProcessId="1", processName="last"),
    dict(processId="3", parentProcessId="2", args=""),
    dict(processId="4", parentProcessId="null", cmdLine="four"),
    dict(processId="5", parentProcessId="None"),
    dict(processId="6", parentProcessId="6", args="self"),
    dict(threadId="t7", parentProcessId="3", args="seven"),
    dict(args="nobody"),
]
NODES = {("1", None), ("2", "last"), ("3", ""), ("4", "four"), ("5", "unknown"), ("6", "self"), ("t7", "seven"), ("UNKNOWN", "nobody")}
EDGES = {("1", "2"), ("2", "3"), ("6", "6"), ("3", "t7")}


def test_nodes_and_edges(spark):
    logs = logs_of(spark, ROWS)
    assert pairs(graph.process_nodes(logs, ["pos"])) == NODES
    assert pairs(graph.spawn_edges(logs)) == EDGES
    nodes, edges = jobs.build_graph(logs, new_folder(spark, "graph"), ["pos"])
    assert pairs(nodes) == NODES and pairs(edges) == EDGES


def test_first_record_wins_unless_named_as_parent_before(spark):
    rows = [
        dict(processId="2", parentProcessId="1", cmdLine="a", userId="u", is_evil=1),
        dict(processId="2", cmdLine="b"),
        dict(processId="1", cmdLine="late"),
        dict(processId="3", parentProcessId="3", cmdLine="own"),
    ]
    got = pairs(graph.process_nodes(logs_of(spark, rows), ["pos"], keep="first"))
    assert got == {("2", "a", "u", 1), ("1", None, None, None), ("3", "own", None, 0)}


def test_typed_edges(spark):
    rows = [
        dict(processId="1", event_type="EVENT_OPEN", file_path="/a", timestamp_ns=1700000000000000001),
        dict(processId="1", event_type="EVENT_OPEN", file_path="/a", timestamp_ns=1700000000000000002),
        dict(processId="1", event_type="EVENT_OPEN", file_path="/a", timestamp_ns=1700000000000000002),
        dict(processId="1", event_type="EVENT_MMAP", file_path="/b"),
        dict(processId="1", event_type="socket", timestamp=1.5),
        dict(processId="1", parentProcessId="0", remote_ip="9.9.9.9"),
    ]
    logs = logs_of(spark, rows)
    got = {(r.rel, r.src, r.dst, r.port, r.type) for r in graph.typed_edges(logs).collect()}
    assert got == {
        (fv.ACCESSED, "1", "/a", None, "EVENT_OPEN"),
        (fv.CONNECTED_TO, "1", "LOCAL_SOCKET", "ANY", "socket"),
        (fv.SPAWNED, "0", "1", None, "UNKNOWN"),
        (fv.CONNECTED_TO, "1", "9.9.9.9", "ANY", "UNKNOWN"),
    }
    assert graph.typed_edges(logs).count() == 5
    assert pairs(graph.file_nodes(logs)) == {("/a",)}
    assert pairs(graph.network_nodes(logs)) == {("LOCAL_SOCKET", "ANY"), ("9.9.9.9", "ANY")}


def random_rows(n, seed):
    r = random.Random(seed)
    return [dict(processId=str(r.randrange(20)), parentProcessId=r.choice([None, "None", str(r.randrange(25))]),
                 args=r.choice([None, "", f"c{i}"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_do_not_depend_on_partitioning(spark, seed):
    rows = random_rows(300, seed)
    logs = logs_of(spark, rows)
    expected = {}
    for row in rows:
        parent = row["parentProcessId"]
        if parent not in (None, "None"):
            expected.setdefault(parent, None)
        expected[row["processId"]] = row["args"] if row["args"] is not None else "unknown"
    for frame in (logs.repartition(1), logs.repartition(7), logs.orderBy(F.desc("pos"))):
        assert dict(pairs(graph.process_nodes(frame, ["pos"]))) == expected


def test_loads_are_idempotent_and_compact(spark, tmp_path):
    logs = logs_of(spark, random_rows(300, 3))
    path, folded = str(tmp_path / "g"), str(tmp_path / "h")
    for load in (2, 0, 1, 1, 2):
        streaming.add_to_graph(logs.filter(F.col("pos") % 3 == load), path, load, ["pos"])
    expected = (pairs(graph.process_nodes(logs, ["pos"])), pairs(graph.spawn_edges(logs)))
    assert tuple(map(pairs, streaming.read_grown_graph(spark, path))) == expected
    streaming.compact_graph(spark, path, folded)
    assert tuple(map(pairs, streaming.read_grown_graph(spark, folded))) == expected
    streaming.add_to_graph(logs.filter(F.col("pos") % 3 == 0), folded, 9, ["pos"])
    assert tuple(map(pairs, streaming.read_grown_graph(spark, folded))) == expected


def brute_context(nodes, edges, pid):
    """Smallest parent, then its smallest parent, by the definition."""
    up = lambda x: min((s for s, d in edges if d == x), default=None)
    parent = up(pid)
    grand = up(parent) if parent is not None else None
    name = lambda x, default: (nodes.get(x) or default) if x is not None else default
    return (f"Grandparent: {name(grand, 'None')}\n  └── Parent: {name(parent, 'Unknown')}\n"
            f"        └── Target: {nodes[pid] or 'Unknown'}")


@pytest.mark.parametrize("seed", [4, 5])
def test_contexts_by_brute_force(spark, seed):
    logs = logs_of(spark, random_rows(120, seed))
    nodes, edges = jobs.build_graph(logs, new_folder(spark, "graph"), ["pos"])
    by_id, pair_set = dict(pairs(nodes)), pairs(edges)
    expected = {pid: brute_context(by_id, pair_set, pid) for pid in by_id}
    assert dict(pairs(ancestry.short_contexts(nodes, edges))) == expected
    some = sorted(by_id)[:5]
    wanted = spark.createDataFrame([(i,) for i in some + ["missing"]], "id string")
    assert dict(pairs(ancestry.short_contexts(nodes, edges, wanted))) == {i: expected[i] for i in some}


def test_unknown_process_gets_default_text(spark):
    logs = logs_of(spark, ROWS)
    contexts = ancestry.short_contexts(graph.process_nodes(logs, ["pos"]), graph.spawn_edges(logs))
    rows = spark.createDataFrame([("2",), ("nope",), (None,)], "process_id string")
    got = dict(pairs(ancestry.attach_context(rows, contexts, fv.NO_SHORT_CONTEXT)))
    assert got["nope"] == got[None] == "No extended context found."
    assert got["2"].endswith("Target: last")


def test_artifact_lists_are_cut_and_counts_whole(spark):
    rows = [dict(processId="1", event_type="EVENT_WRITE", file_path=f"/f{i % 9}") for i in range(30)]
    rows += [dict(processId="1", event_type="EVENT_CONNECT", remote_ip=f"10.0.0.{i % 4}") for i in range(30)]
    rows += [dict(processId="2", event_type="EVENT_FORK")]
    logs = logs_of(spark, rows)
    got = ancestry.artifacts(graph.touched(logs)).collect()
    assert [tuple(r) for r in got] == [
        ("1", [f"/f{i}" for i in range(5)], [f"10.0.0.{i}" for i in range(3)], 9, 4)]
    contexts = dict(pairs(ancestry.long_contexts(
        graph.process_nodes(logs, ["pos"]), graph.spawn_edges(logs), graph.touched(logs))))
    assert contexts["1"].endswith("Files: /f0, /f1, /f2, /f3, /f4\nNetwork IPs: 10.0.0.0, 10.0.0.1, 10.0.0.2")
    assert contexts["2"].endswith("Files: None\nNetwork IPs: None")
    assert contexts["2"].startswith("--- EXECUTION CHAIN ---\nGrandparent Process: Unknown\n")


def test_hot_keys_and_spread_lookup(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"), "id")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(0, 50, 2)], "name string, value int")
    assert hot_keys(rows, "key", task_rows=300) == {"hot": 4}
    assert hot_keys(rows, "key", task_rows=40)["hot"] == 25
    assert hot_keys(rows, "key") == {}
    for how in ("left", "inner"):
        plain = rows.join(table, F.col("key") == F.col("name"), how)
        for hot in ({}, {"hot": 7}, {"hot": 3, "k1": 2, "k2": 5}):
            spread = lookup(rows, "key", table, "name", how, hot=hot)
            assert spread.columns == plain.columns
            assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    spread = lookup(rows, "key", table, "name", "inner", hot={"hot": 16})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spread.filter("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_property_graph_is_stored_whole_and_grows(spark, tmp_path):
    logs = logs_of(spark, ROWS)
    stored = jobs.build_property_graph(logs, str(tmp_path / "g"), ["pos"])
    rows = lambda frame: sorted(map(str, frame.select(sorted(frame.columns)).collect()))
    assert rows(stored["typed_edges"]) == rows(graph.typed_edges(logs))
    assert rows(stored["file_nodes"]) == rows(graph.file_nodes(logs))
    assert rows(stored["network_nodes"]) == rows(graph.network_nodes(logs))
    assert rows(graph.touched_of(stored["typed_edges"])) == rows(graph.touched(logs))
    path = str(tmp_path / "grown")
    for load in (0, 1, 1, 2):
        streaming.add_to_graph(logs.filter(F.col("pos") % 3 == load), path, load, ["pos"])
    assert rows(streaming.read_grown_typed_edges(spark, path)) == rows(graph.typed_edges(logs))
    streaming.compact_graph(spark, path, path + "2")
    assert rows(streaming.read_grown_typed_edges(spark, path + "2")) == rows(graph.typed_edges(logs))
