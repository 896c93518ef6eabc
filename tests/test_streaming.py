import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tracehold.operators import figures, graph, scoring, training
from tracehold.plans import jobs
from tracehold.plans.queries import digest_model
from tracehold.sources.id_numbers import IdNumbers
from tracehold.sources.merge_store import MergeStore
from tracehold.streaming import jobs as streaming


def incoming(folder, n=120, files=4):
    folder.mkdir()
    lines = [json.dumps({"processId": i % 9, "parentProcessId": (i % 9) // 2 or None, "timestamp": float(i),
                         "args": ["ls", "curl x", "run"][i % 3] + f" {i}", "is_evil": int(i % 5 == 0)})
             for i in range(n)]
    for f in range(files):
        part = lines[f * n // files:(f + 1) * n // files]
        (folder / f"part-{f}.json").write_text("\n".join(part + ["{broken"]) + "\n")
    return str(folder)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def with_scores(logs):
    return scoring.with_score(logs, F.lit(0.2))


def test_stream_equals_batch(spark, tmp_path):
    path = incoming(tmp_path / "in")
    batch = with_scores(jobs.load_logs(spark, path, "lines"))
    stream = with_scores(streaming.stream_logs(spark, path, maxFilesPerTrigger=1))
    assert stream.isStreaming and "event_time" in stream.columns
    out = str(tmp_path / "alerts")
    run(streaming.alerts_to_files(stream, out, str(tmp_path / "c1")))
    key = lambda f: sorted((r.timestamp, r.process_id, r.score) for r in f.collect())
    got = key(spark.read.parquet(out))
    assert got == key(batch.filter(scoring.is_alert())) and len(got) == 40


def test_model_scores_on_a_stream_equal_batch(spark, tmp_path):
    path = incoming(tmp_path / "in")
    weights = training.initial_weights(2)
    stream = scoring.score_logs(streaming.stream_logs(spark, path), weights)
    out = str(tmp_path / "scores")
    run(stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "c")))
    batch = scoring.score_logs(jobs.load_logs(spark, path, "lines"), weights)
    key = lambda f: sorted((r.timestamp, r.base_score, r.score) for r in f.collect())
    assert key(spark.read.parquet(out)) == key(batch)


def test_running_confusion_equals_batch(spark, tmp_path):
    path = incoming(tmp_path / "in")
    stream = streaming.running_confusion(with_scores(streaming.stream_logs(spark, path, maxFilesPerTrigger=1)))
    seen = []
    run(stream.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(lambda batch, _: seen.append(batch.first().asDict())))
    whole = jobs.triage_metrics(with_scores(jobs.load_logs(spark, path, "lines"))).first().asDict()
    assert len(seen) == 4 and [s["n"] for s in seen] == [30, 60, 90, 120]
    assert seen[-1] == {k: whole[k] for k in ("tp", "fp", "tn", "fn", "n")}


def test_stream_upsert_equals_batch(spark, tmp_path):
    path, out = incoming(tmp_path / "in"), str(tmp_path / "graph")
    run(streaming.upsert_graph(
        streaming.stream_logs(spark, path, maxFilesPerTrigger=1), out, str(tmp_path / "c"), ["timestamp"]))
    logs = jobs.load_logs(spark, path, "lines")
    nodes, edges = streaming.read_grown_graph(spark, out)
    rows = lambda f: sorted(tuple(map(str, r)) for r in f.collect())
    assert rows(nodes) == rows(graph.process_nodes(logs, ["timestamp"]))
    assert rows(edges) == rows(graph.spawn_edges(logs))


def merged_rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_merge_store_after_many_loads(spark, tmp_path):
    path = str(tmp_path / "store")
    store = MergeStore(spark, path, ["k"], lambda r: r.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at")),
                       buckets=4, fanout=3)
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    expected, at = {}, 0
    for load in range(50):
        rows = []
        for k in {load % 7, (load * load) % 11, None if load == 9 else 100 + load}:
            at += 1
            rows.append((k, f"{load}-{k}", at))
            expected[k] = rows[-1][1:]
        frame = spark.createDataFrame(rows, "k long, v string, at long")
        before = store.runs()
        assert store.add(frame, load)
        touched = {r._b for r in frame.select(store._bucket(4).alias("_b")).collect()}
        assert {r for r in before if r[0] not in touched} <= set(store.runs())  # other buckets are not rewritten
        if load % 10 == 3:
            assert not store.add(spark.createDataFrame([(1, "again", 10**6)], "k long, v string, at long"), load)
    assert {r.k: (r.v, r["at"]) for r in store.read().collect()} == expected
    assert len(store.runs()) <= 4 * 2 * 4  # buckets, runs of a level, levels
    files = store.read().inputFiles()
    assert len(files) == len(store.runs())
    on_disk = [f for f in (tmp_path / "store").rglob("*.parquet")]
    assert len(on_disk) <= 3 * len(files) + 8  # what neither of the last two manifests names is gone
    other = store.copy_to(str(tmp_path / "copy"), buckets=2)
    assert merged_rows(other.read().where("k IS NOT NULL")) == merged_rows(store.read().where("k IS NOT NULL"))
    assert len(other.runs()) <= 2 and not other.add(frame, 49) and other.add(frame.limit(0), 50)


def test_a_load_that_fails_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = MergeStore(spark, str(tmp_path / "store"), ["k"], lambda r: r.distinct(), buckets=2, fanout=2)
    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    store.add(frame(1, 2, 3), 0)
    runs = store.runs()
    with monkeypatch.context() as broken:
        broken.setattr("tracehold.sources.merge_store.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(frame(4, 5, 6), 1)
    assert store.runs() == runs and merged_rows(store.read()) == [(1,), (2,), (3,)]
    assert store.add(frame(4, 5), 1) and merged_rows(store.read()) == [(k,) for k in range(1, 6)]


def test_grown_graph_is_copied_and_grows_on(spark, tmp_path):
    logs = jobs.load_logs(spark, incoming(tmp_path / "in"), "lines").withColumn("timestamp", F.col("timestamp") + 0)
    part = lambda k: logs.where(F.pmod(F.hash("timestamp"), F.lit(3)) == k)
    old, new = str(tmp_path / "graph"), str(tmp_path / "copy")
    for k in (0, 1):
        streaming.add_to_graph(part(k), old, k, ["timestamp"], buckets=3)
    streaming.compact_graph(spark, old, new)
    for k in (1, 2):
        streaming.add_to_graph(part(k), new, k, ["timestamp"])
    nodes, edges = streaming.read_grown_graph(spark, new)
    text = lambda f: sorted(tuple(map(str, r)) for r in f.collect())
    assert text(nodes) == text(graph.process_nodes(logs, ["timestamp"])) and text(edges) == text(graph.spawn_edges(logs))
    assert text(streaming.read_grown_typed_edges(spark, new)) == text(graph.typed_edges(logs))


def test_stream_upsert_by_arrival(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("b", "first"), ("a", "second")):
        (folder / f"{name}.json").write_text("\n".join(
            json.dumps({"processId": 1, "args": f"{text} {i}"}) for i in range(50)))
        run(streaming.upsert_graph(
            streaming.stream_logs(spark, str(folder)), str(tmp_path / "graph"), str(tmp_path / "c")))
    nodes, _ = streaming.read_grown_graph(spark, str(tmp_path / "graph"))
    assert [tuple(r) for r in nodes.collect()] == [("1", "second 49")]


def test_stream_triage(spark, tmp_path):
    path = incoming(tmp_path / "in", n=24, files=2)
    logs = jobs.load_logs(spark, path, "lines")
    nodes, edges = jobs.build_graph(logs, str(tmp_path / "graph"))
    out = str(tmp_path / "reports")
    run(streaming.triage_stream(
        with_scores(streaming.stream_logs(spark, path, maxFilesPerTrigger=1)),
        lambda: nodes, lambda: edges, digest_model, out, str(tmp_path / "c")))
    expected = jobs.triage(with_scores(logs), nodes, edges, digest_model)
    key = lambda f: sorted((r.timestamp, r.process_id, r.report) for r in f.collect())
    assert key(spark.read.parquet(out)) == key(expected) and expected.count() == 8


def test_scratch_tables_are_deleted(spark):
    from tracehold import session

    with session.scratch(spark):
        frame = session.materialize(spark.range(5), "step")
        folder = frame.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
        assert "/scratch-" in folder and os.path.isdir(folder)
        with session.scratch(spark):
            assert session.new_folder(spark, "x").startswith(folder.rstrip("/"))
        assert frame.count() == 5
    assert not os.path.exists(folder)
    assert "/scratch-" not in session.new_folder(spark, "x")


def test_numbers_stay_while_a_graph_grows(spark, tmp_path, monkeypatch):
    numbers = IdNumbers(spark, str(tmp_path / "numbers"), buckets=2)
    frame = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "id string, idx long")
    held, start = {}, 0
    for load in range(12):  # each load repeats ids of earlier ones, and itself
        new = [f"n{(load * 7 + k) % 10}-{load}" for k in range(load % 4)]
        assert numbers.add(frame(None, *new, *new, *list(held)[:3]), load)
        assert not numbers.add(frame("late"), load)
        held |= {i: start + k for k, i in enumerate(sorted(new))}
        start += len(new)
        assert load % 4 != 3 or {r.id: r.idx for r in numbers.read().collect()} == held
    assert numbers.read().count() == len(held) and sorted(held.values()) == list(range(len(held)))
    assert len(numbers.store.runs()) <= 2 * 3 * 3  # buckets, runs of a level, levels
    with monkeypatch.context() as broken:
        broken.setattr("tracehold.sources.merge_store.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            numbers.add(frame("x", "y"), 12)
    assert numbers.add(frame("y"), 12)
    assert {r.id: r.idx for r in numbers.read().collect()} == held | {"y": start}


def test_figures_of_a_run(spark, tmp_path):
    path = incoming(tmp_path / "in")
    rows = jobs.score_files(spark, path, str(tmp_path / "out"), with_scores, "lines").collect()
    got = {(r.stage, r.measure): r.value for r in rows}
    assert got.pop(("run", "seconds")) > 0
    assert got == {("read", "records"): 124, ("parse", "rejected"): 4, ("logs", "logs"): 120, ("logs", "malicious"): 24,
                   ("logs", "benign"): 96, ("score", "alerts"): 40}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    empty = figures.Figures(spark)
    with empty.timed("nothing"):
        empty.watch(spark.range(0), "none", rows=F.count("*"), top=F.max("id")).collect()
    assert {(r.stage, r.measure): r.value for r in empty.table().collect() if r.measure != "seconds"} == {
        ("none", "rows"): 0, ("none", "top"): 0}
    failed = figures.Figures(spark)
    with pytest.raises(Exception, match="no such"), failed.timed("bad"):
        failed.watch(spark.range(3), "rows", rows=F.count("*")).select(F.raise_error(F.lit("no such"))).collect()
    assert failed.table().count() == 0


def test_figures_of_a_stream(spark, tmp_path):
    path, out = incoming(tmp_path / "in"), str(tmp_path / "figures")
    listener = figures.StreamFigures(spark, out, ("scored",))
    assert figures.read_stream_figures(spark, out).count() == 0
    logs = figures.watch_stream(streaming.stream_logs(spark, path, maxFilesPerTrigger=1), "logs", logs=F.count("*"))
    scored = figures.watch_stream(with_scores(logs), "score", alerts=F.count_if(scoring.is_alert()))
    spark.streams.addListener(listener)
    try:
        run(streaming.alerts_to_files(scored, str(tmp_path / "alerts"), str(tmp_path / "c")).queryName("scored"))
        wanted = {("batch", "rows"): 124, ("logs", "logs"): 120, ("score", "alerts"): 40}
        for _ in range(100):  # events arrive after the batch
            rows = figures.read_stream_figures(spark, out).collect()
            got = {k: sum(r.value for r in rows if (r.stage, r.measure) == k) for k in wanted}
            if got == wanted:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert got == wanted and len({r.batch for r in rows}) == 4
    assert all(r.value > 0 for r in rows if r.measure == "seconds")


def test_each_bucket_is_written_by_a_task_of_its_own(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path / "store"), ["a", "b"], lambda r: r.distinct(), buckets=16)
    for load in range(5):  # the first four runs become one of the next level
        store.add(spark.range(2000).select(F.col("id").alias("a"), F.concat(F.lit(f"{load % 3}-"), "id").alias("b")), load)
    assert {level for _, level, _ in store.runs()} == {0, 1} and store.read().count() == 6000
    for level in (0, 1):
        names = [f.name for b, n, folder in store.runs() if n == level for f in (tmp_path / "store" / folder).glob("*.parquet")]
        assert len(names) == 16 and len({n.split("-")[1] for n in names}) == 16


def test_a_load_is_numbered_by_the_links_it_adds(spark, tmp_path, monkeypatch):
    logs = jobs.load_logs(spark, incoming(tmp_path / "in"), "lines")
    one, two, read = str(tmp_path / "one"), str(tmp_path / "two"), []
    links = graph.spawn_links
    for load in (0, 1, 1, 2):
        part = logs.filter(F.pmod(F.col("timestamp").cast("long"), F.lit(3)) == load)
        streaming.add_to_graph(part, one, load)
        streaming.number_nodes(part, one, load)
        with monkeypatch.context() as counted:
            counted.setattr(graph, "spawn_links", lambda *a: read.append(a) or links(*a))
            streaming.add_links(part, two, load, numbered=True)
    assert len(read) == 4
    for a, b in zip(streaming.read_grown_index(spark, one), streaming.read_grown_index(spark, two), strict=True):
        assert merged_rows(a) == merged_rows(b) and a.count() > 5
    assert streaming.node_numbers(spark, two).store.loads() == [0, 1, 2]
