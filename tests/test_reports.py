import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tracehold.operators import evaluate, prompts, reports
from tracehold.operators.answers import AnswerStore
from tracehold.plans import jobs
from tracehold.plans.queries import digest_model, rule_analyst
from tracehold.session import new_folder
from tracehold.sinks.logs import write_matrix
from tracehold.functions import fixed_values as fv
from tracehold.functions.text import strip_fences

from tests.test_graph import ROWS, logs_of

# The only recorded results: (model, tp, fp, tn, fn) and the percentages they give.
GOLDEN = {
    "phi4-mini": ((8, 2, 18, 12), ("65.00", "80.00", "40.00", "53.33")),
    "qwen2.5-coder:7b": ((5, 0, 20, 15), ("62.50", "100.00", "25.00", "40.00")),
    "llama3.1:8b": ((17, 1, 19, 3), ("90.00", "94.44", "85.00", "89.47")),
    "deepseek-r1:14b": ((11, 7, 13, 9), ("60.00", "61.11", "55.00", "57.89")),
    "codestral": ((3, 6, 14, 17), ("42.50", "33.33", "15.00", "20.69")),
    "qwen3:32b": ((17, 1, 19, 3), ("90.00", "94.44", "85.00", "89.47")),
}
SECONDS = {"phi4-mini": 528.09, "qwen2.5-coder:7b": 287.34, "llama3.1:8b": 785.64,
           "deepseek-r1:14b": 7025.11, "codestral": 768.15, "qwen3:32b": 5522.13}


def test_golden_metrics_and_matrix_file(spark, tmp_path):
    rows = []
    for model, (counts, _) in GOLDEN.items():
        for outcome, n in zip(("TP", "FP", "TN", "FN"), counts):
            rows += [(model, outcome)] * n
    graded = spark.createDataFrame(rows, "model string, outcome string")
    counts = evaluate.confusion(graded, ["model"])
    seconds = spark.createDataFrame(list(SECONDS.items()), "model string, seconds double")
    metrics = evaluate.metrics(counts, 100.0).join(seconds, "model")
    path = str(tmp_path / "matrix")
    write_matrix(metrics, path, list(GOLDEN))
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    assert len(lines) == 1
    table = [line.split(",") for line in lines[0].strip().split("\n")]
    assert tuple(table[0]) == fv.MATRIX_HEADER
    assert table[1:] == [[m, *p, str(SECONDS[m])] for m, (_, p) in GOLDEN.items()]


def test_metrics_without_rows_or_hits(spark):
    empty = spark.createDataFrame([], "outcome string")
    row = evaluate.metrics(evaluate.confusion(empty)).first()
    assert (row.n, row.accuracy, row.precision, row.recall, row.f1) == (0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("text,expected", [
    ("MALICIOUS!", True), ("not malicious", True), ("malicious, not Benign", False), ("fine", False), (None, None)])
def test_verdict_words(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(evaluate.says_malicious(F.col("t"))).first()[0] is expected


def test_failed_calls_stay_in_the_denominator(spark):
    rows = [("malicious", 1, None), ("malicious", 0, None), (None, 1, "timeout"), ("benign", 0, None)]
    graded = evaluate.grade(spark.createDataFrame(rows, "text string, is_evil int, error string"))
    row = evaluate.metrics(evaluate.confusion(graded)).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.n, row.accuracy) == (1, 1, 1, 0, 4, 0.5)


@pytest.mark.parametrize("n", [0, 1, 30, 700, 5000])
def test_tasks_pass_on_all_that_may_be_in_the_sample(spark, n):
    rows = spark.range(0, 4000, 1, 5).selectExpr("id", "CAST(id % 7 = 0 AS INT) AS _class", "CAST(pmod(hash(id), 65536) AS INT) AS _range")
    everything, got = rows.collect(), evaluate._low_rows(rows, n).collect()
    assert set(got) <= set(everything)
    for kind in (0, 1):
        lowest = sorted((r for r in everything if r._class == kind), key=lambda r: r._range)[:n]
        assert {r._range for r in lowest} <= {r._range for r in got if r._class == kind}
        assert all(r in got for r in everything if r._class == kind and lowest and r._range <= lowest[-1]._range)
    if n == 1:
        assert len(got) < 200


def test_balanced_sample(spark):
    logs = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 100 == 0).cast("int").alias("is_evil"))
    sample = evaluate.balanced_sample(logs, ["pos"], n=20, seed=1)
    counts = {r["class"]: r.n_logs for r in evaluate.class_counts(sample).collect()}
    assert counts == {"Malicious": 10, "Benign": 20}
    again = evaluate.balanced_sample(logs.repartition(7), ["pos"], n=20, seed=1)
    other = evaluate.balanced_sample(logs, ["pos"], n=20, seed=2)
    ids = lambda f: {r.pos for r in f.collect()}
    assert ids(sample) == ids(again) != ids(other)
    mixed = [r.pos for r in evaluate.shuffled(sample, ["pos"]).collect()]
    assert set(mixed) == ids(sample) and mixed != sorted(mixed)


@pytest.mark.parametrize("n", [1, 40, 990, 1500])
def test_samples_take_the_smallest_keys(spark, n):
    logs = spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).cast("int").alias("is_evil"))
    got = sorted(r.pos for r in evaluate.balanced_sample(logs, ["pos"], n=n, seed=5).collect())
    keys = {r.pos: r.k for r in logs.select("pos", evaluate.sample_key(5, F.col("pos")).alias("k")).collect()}
    classes = [sorted((p for p in keys if (p % 3 == 0) == evil), key=lambda p: (keys[p], p)) for evil in (True, False)]
    assert got == sorted(p for c in classes for p in c[:n])


def test_timed():
    assert evaluate.timed(lambda: 5)[0] == 5


@pytest.mark.parametrize("command,expected", [
    ("kill -9 42", []), ("kill -STOP 42 43", ["kill_other"]), ("sudo kill 7", ["kill_other"]),
    ("rm -rf /", ["root_delete"]), ("rm -fr --no-preserve-root /*", ["root_delete"]),
    ("rm --recursive /; ls", ["root_delete"]), ("rm -rf /tmp/x", []), ("rm /", []), ("farm -r /", []),
    ("shutdown -h now\nDROP TABLE x", ["shutdown", "database_wipe"]), ("init 0", ["shutdown"]),
    ("killall sshd", ["kill_by_name"]), ("iptables -A INPUT -s 1.2.3.4 -j DROP", []), ("", []), (None, [])])
def test_command_audit(spark, command, expected):
    frame = spark.createDataFrame([(command, "42")], "c string, pid string")
    assert frame.select(reports.unsafe_commands(F.col("c"), F.col("pid"))).first()[0] == expected


def test_strip_fences(spark):
    frame = spark.createDataFrame([("\n```bash\nls -l\n``` \n",), ("a```b",)], "t string")
    assert [r[0] for r in frame.select(strip_fences(F.col("t"))).collect()] == ["ls -l", "ab"]


def test_prompt_fields_are_data_not_templates(spark):
    frame = spark.createDataFrame([("{context}", "x {pid}")], "pid string, context string")
    chat = frame.select(prompts.messages(prompts.ANALYSIS, pid=F.col("pid"), context=F.col("context"))).first()[0]
    assert [m.role for m in chat] == ["system", "user"]
    assert chat[1].content == '<provenance process="{context}">\nx {pid}\n</provenance>\nWhat happened, and by which technique?'


def failing_client():
    lock, seen = threading.Lock(), {}

    def answer(chat):
        text = chat[-1]["content"]
        with lock:
            seen[text] = seen.get(text, 0) + 1
        if "bad" in text or ("flaky" in text and seen[text] == 1):
            raise RuntimeError("no answer")
        return text.upper()

    return answer


def test_model_calls_retry_and_report_errors(spark):
    rows = [(i, name) for i, name in enumerate(["good", "bad", "flaky"] * 5)]
    frame = spark.createDataFrame(rows, "request_id long, text string").select(
        "request_id", prompts.messages(prompts.Template("s", "{t}"), t=F.concat("text", F.col("request_id"))).alias("messages"))
    got = {r.request_id: r for r in prompts.call_model(frame, failing_client, tasks=3).collect()}
    assert len(got) == 15
    for i, name in rows:
        if name == "bad":
            assert got[i].response is None and "no answer" in got[i].error
        else:
            assert got[i].response == f"{name}{i}".upper() and got[i].error is None
        assert got[i].seconds >= 0


def test_failed_stage_ends_that_process_only(spark):
    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "process_id string, context string")
    done = {r.process_id: r for r in reports.incident_reports(rows, failing_client).collect()}
    assert done["2"].report is None and "no answer" in done["2"].error
    assert done["1"].error is None
    assert done["1"].report.startswith("--- 1. GRAPH CONTEXT ---\ngood\n\n--- 2. THREAT ANALYSIS ---\n<PROVENANCE PROCESS=\"1\">")


def test_report_asks_once_per_process(spark):
    logs = logs_of(spark, ROWS * 3)
    nodes, edges = jobs.build_graph(logs, new_folder(spark, "graph"), ["pos"])
    scored = logs.withColumn("score", F.when(F.col("process_id") == "4", 0.1).otherwise(0.9))
    done = jobs.triage(scored, nodes, edges, digest_model).collect()
    assert len(done) == 3 * 7 and all(r.report for r in done)
    assert len({(r.process_id, r.report) for r in done}) == len({r.process_id for r in done})


def test_compare_models(spark):
    logs = logs_of(spark, [dict(r, is_evil=int("args" in r)) for r in ROWS])
    contexts = spark.createDataFrame([("2", "ran wget")], "id string, context string")
    result = jobs.compare_models(logs, contexts, {"a": rule_analyst, "b": failing_client}, "pos", F.col("args"))
    rows = {r.model: r for r in result.collect()}
    assert (rows["a"].tp, rows["a"].fp, rows["a"].tn, rows["a"].fn, rows["a"].n) == (1, 1, 2, 4, 8)
    assert rows["b"].n == 8 and rows["a"].seconds >= 0
    one = jobs.evaluate_model(logs, contexts, rule_analyst, "pos", F.col("args"), n=2).first()
    assert (one.n, one.tp + one.fn, one.fp + one.tn) == (4, 2, 2)


def counted_model(folder):
    """A digest model that leaves a file for each call; it fails where the text says so."""
    def connect():
        answer = digest_model()

        def ask(chat):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                file.write(chat[-1]["content"])
            if "fails" in chat[-1]["content"]:
                raise ValueError("no")
            return answer(chat)

        return ask

    return connect


def test_answers_are_kept_by_content(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = AnswerStore(spark, str(tmp_path / "answers"))
    template = prompts.Template("be brief", "about {what}")
    frame = lambda *rows: spark.createDataFrame(rows, "id string, what string").select(
        "id", prompts.messages(template, what=F.col("what")).alias("messages"))
    ask = lambda f, s=store: {r.id: r for r in s.answer(f, counted_model(str(calls)), "id", attempts=1).collect()}
    first = ask(frame(("a", "x"), ("b", "x"), ("c", "y"), ("d", "fails")))
    assert len(os.listdir(calls)) == 3 and first["a"].response == first["b"].response != first["c"].response
    assert first["d"].response is None and "ValueError" in first["d"].error and first["a"].error is None
    second = ask(frame(("e", "x"), ("f", "z"), ("g", "fails")), AnswerStore(spark, str(tmp_path / "answers")))
    assert len(os.listdir(calls)) == 5  # z, and what failed before
    assert second["e"].response == first["a"].response and second["e"].seconds == 0.0 and second["g"].error
    other = ask(frame(("e", "x")), AnswerStore(spark, str(tmp_path / "answers"), "other model"))
    assert len(os.listdir(calls)) == 6 and other["e"].response
    assert ask(frame(("e", "x")).limit(0)) == {}


def test_a_process_is_asked_about_once_over_batches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    contexts = lambda *ids: spark.createDataFrame([(i, f"context of {i}") for i in ids], "process_id string, context string")
    store = AnswerStore(spark, str(tmp_path / "answers"))
    run = lambda *ids: {r.process_id: r.report for r in reports.incident_reports(
        contexts(*ids), counted_model(str(calls)), store=store).collect()}
    one, two = run("1", "2"), run("2", "3")
    assert len(os.listdir(calls)) == 3 * 4 and one["2"] == two["2"]
    plain = {r.process_id: r.report for r in reports.incident_reports(contexts("1", "2", "3"), digest_model).collect()}
    assert plain == one | two


def test_a_call_that_hangs_is_an_error(spark):
    def connect():
        def ask(chat):
            if "slow" in chat[-1]["content"]:
                time.sleep(30)
            return "ok"

        return ask

    frame = spark.createDataFrame([("a", "slow"), ("b", "fast")], "id string, t string").select(
        "id", prompts.messages(prompts.Template("s", "{t}"), t=F.col("t")).alias("messages"))
    start = time.monotonic()
    got = {r.id: r for r in prompts.call_model(frame, connect, "id", attempts=1, timeout=0.5).collect()}
    assert "TimeoutError" in got["a"].error and got["b"].response == "ok" and time.monotonic() - start < 25
