import gzip
import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tracehold.operators.normalize import canonical_logs
from tracehold.plans import jobs
from tracehold.plans.jobs import load_logs
from tracehold.sinks.logs import write_logs
from tracehold.sources import archives, json_blocks, json_logs, labelled_csv

LOGS = [
    {"processId": 7, "parentProcessId": "1", "args": ["-c", {"x": 1}], "is_evil": 1},
    {"process_id": "8", "cmdLine": "ls {\n", "timestamp": 1.5},
    {"thread_id": 9, "userId": None, "is_evil": None},
]
EXPECTED = [("7", "1", '["-c",{"x":1}]', None, 1), ("8", None, None, "ls {\n", 0), (None, None, None, None, 0)]


def shown(logs):
    rows = logs.orderBy("src_file", "src_block", "src_row").collect()
    return [(r.process_id, r.parent_process_id, r.args, r.cmd_line, r.is_evil) for r in rows]


def write(folder, name, text):
    data = text if isinstance(text, bytes) else text.encode()
    (folder / name).write_bytes(data)
    return str(folder)


PRETTY = "\n".join(json.dumps(x, indent=2) for x in LOGS)


@pytest.mark.parametrize("layout,text", [
    ("files", json.dumps(LOGS)),
    ("files", json.dumps(LOGS, indent=2)),
    ("files", " ".join(json.dumps(x) for x in LOGS)),
    ("files", "\n\n" + PRETTY),
    ("files", repr(LOGS)),
    ("lines", "\n".join(json.dumps(x) for x in LOGS) + "\n\n"),
    ("objects", PRETTY),
    ("objects", PRETTY + "\n"),
])
def test_layouts(spark, tmp_path, layout, text):
    assert shown(load_logs(spark, write(tmp_path, "a.json", text), layout)) == EXPECTED


def test_labels_of_any_kind(spark, tmp_path):
    values = [1, 0, "1", 1.0, True, False, None, "x", "", 2]
    path = write(tmp_path, "a.json", "\n".join(json.dumps({"is_evil": v}) for v in values))
    rows = load_logs(spark, path, "lines").orderBy("src_row").collect()
    assert [r.is_evil for r in rows] == [1, 0, 1, 1, 1, 0, 0, 0, 0, 2]


def test_indented_array_by_object_end(spark, tmp_path):
    path = write(tmp_path, "a.json", json.dumps(LOGS, indent=2))
    records = json_logs.read_json_objects(spark, path, "\n  }")
    assert shown(canonical_logs(json_logs.accepted(json_logs.parse_json(records)))) == EXPECTED


def test_objects_across_many_splits(spark, tmp_path):
    rows = [{"process_id": str(i), "cmdLine": "x" * (i % 50)} for i in range(3000)]
    path = write(tmp_path, "a.json", "\n".join(json.dumps(r, indent=1) for r in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = json_logs.read_json_objects(spark, path)
        assert frame.rdd.getNumPartitions() > 8
        got = load_logs(spark, path, "objects").orderBy("src_file", "src_block", "src_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.process_id, r.cmd_line) for r in got] == [(r["process_id"], r["cmdLine"]) for r in rows]


def test_malformed_lines_are_rejected(spark, tmp_path):
    lines = ['{"process_id": 1}', '{"process_id": 2', '{"process_id": 3} x', "5", '{"process_id": 4}{"process_id": 5}',
             "{'process_id': 6}", '{"process_id": 7}']
    path = write(tmp_path, "a.json", "\n".join(lines))
    parsed = json_logs.parse_json(json_logs.read_json_lines(spark, path))
    assert [r.process_id for r in json_logs.accepted(parsed).orderBy("src_row").collect()] == ["1", "7"]
    assert sorted(r.rejected for r in json_logs.rejects(parsed).collect()) == sorted(lines[1:6])


def test_broken_tail_keeps_prefix_or_drops_file(spark, tmp_path):
    write(tmp_path, "a.json", '{"process_id": 1}\n{"process_id": 2}\n{"process_id": ')
    path = write(tmp_path, "b.json", '{"process_id": 3}')
    write(tmp_path, "c.json", "not json at all (")
    decoded = json_logs.read_json_files(spark, path)
    ids = lambda rows: sorted(r.process_id for r in json_logs.parse_json(rows).collect())
    assert ids(json_logs.good_records(decoded)) == ["1", "2", "3"]
    assert ids(json_logs.good_records(decoded, whole_files_only=True)) == ["3"]
    failed = {r.src_file[-6:] for r in json_logs.file_errors(decoded).collect()}
    assert failed == {"a.json", "c.json"}


def test_truncated_records_are_not_completed(spark, tmp_path):
    path = write(tmp_path, "a.json", '{\n "process_id": 1\n}\n{\n "process_id": 23')
    parsed = json_logs.parse_json(json_logs.read_json_objects(spark, path))
    assert [r.process_id for r in json_logs.accepted(parsed).collect()] == ["1"]
    assert json_logs.rejects(parsed).count() == 1
    decoded = json_logs.read_json_files(spark, path)
    assert [json.loads(r.record) for r in json_logs.good_records(decoded).collect()] == [{"process_id": 1}]
    with pytest.raises(Exception, match="not read whole"):
        json_logs.read_logs(spark, path).collect()
    assert json_logs.read_logs(spark, path, partial=True).count() == 1


def test_last_object_without_line_feed(spark, tmp_path):
    for text in ('{\n "process_id": 1\n}', '{\n "process_id": 1\n}\n', '{\n "process_id": 1\n} \n\n'):
        path = write(tmp_path, "a.json", text)
        assert [r.process_id for r in load_logs(spark, path, "objects").collect()] == ["1"], text


@pytest.mark.parametrize("text", ['\t{"process_id": 1}\n \t {"process_id": 2}\n', '[{"process_id": 1},\n{"process_id": 2}]',
                                  '[\n{"process_id": 1}\n,\n  {"process_id": 2},\n]\n'])
def test_lines_in_an_array_or_indented(spark, tmp_path, text):
    path = write(tmp_path, "a.json", text)
    parsed = json_logs.parse_json(json_logs.read_json_lines(spark, path))
    assert sorted(r.process_id for r in json_logs.accepted(parsed).collect()) == ["1", "2"]
    assert json_logs.rejects(parsed).count() == 0


@pytest.mark.parametrize("text", [
    json.dumps(LOGS, indent=0), "\n".join(json.dumps(x, indent=0) for x in LOGS), repr(LOGS).replace(", {", " , {"),
    "[1, null, 'x}{', " + json.dumps(LOGS)[1:-1] + ', "{" ]'])
def test_any_layout(spark, tmp_path, text):
    assert shown(load_logs(spark, write(tmp_path, "a.json", text))) == EXPECTED


def test_objects_that_hold_braces_and_quotes(spark, tmp_path):
    odd = [{"process_id": "a}b{\"'\\\\", "cmdLine": "}}}", "args": [{"x": [{}]}, "]"]}, {"process_id": "it's"}]
    got = load_logs(spark, write(tmp_path, "a.json", json.dumps(odd))).orderBy("src_row").collect()
    assert [r.process_id for r in got] == [x["process_id"] for x in odd]
    assert got[0].cmd_line == "}}}" and got[0].args == '[{"x":[{}]},"]"]'


def test_records_across_splits_keep_their_order(spark, tmp_path):
    path = write(tmp_path, "a.json", json.dumps([{"process_id": str(i), "cmdLine": "é" * (i % 40)} for i in range(3000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = json_logs.read_json_files(spark, path).orderBy("src_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r.record)["process_id"] for r in rows] == [str(i) for i in range(3000)]
    assert [r.src_row for r in rows] == list(range(3000))


@contextmanager
def small_blocks(spark, size=4096):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def file_pieces(spark, path):
    texts = spark.read.text(path, lineSep="}")
    return texts.select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"), F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_size").alias("size"))


LONG = [{"process_id": str(i), "cmdLine": "x}{'é" * (i % 90), "args": [{"a": {"b": i}}, "]"]} for i in range(500)]


GIANT = [LONG[0], {"process_id": "long", "cmdLine": '}"{' * 20_000}, *LONG[1:]]


@pytest.mark.parametrize("text,objects", [
    (json.dumps(LONG), LONG), (repr(LONG), LONG), ("".join(map(json.dumps, LONG)), LONG), (json.dumps(LONG, indent=1), LONG),
    (json.dumps([x for r in LONG for x in (r, "}" * 500)]), LONG), (json.dumps(GIANT), GIANT)])
def test_one_file_is_cut_by_many_blocks(spark, tmp_path, text, objects):
    write(tmp_path, "b.json", '{"process_id": "other"}')
    path = write(tmp_path, "a.json", text)
    with small_blocks(spark):
        pieces = file_pieces(spark, path)
        assert json_blocks.summaries(pieces).count() > 10
        rows = json_blocks.cut_files(pieces, sent_blocks=0 if objects is GIANT else 1000).where(
            "src_file LIKE '%a.json'").orderBy("src_row").collect()
    assert [r.error for r in rows if r.error] == []
    assert [r.src_row for r in rows] == list(range(len(objects)))
    assert [json.loads(r.record) for r in rows] == objects


@pytest.mark.parametrize("edit,error", [
    (lambda t: t[:-40], "ends inside"), (lambda t: t.replace('{"process_id": "400"', '} {"process_id": "400"'), "no log object"),
    (lambda t: t.replace('{"process_id": "400"', '" {"process_id": "400"'), ""), (lambda t: t + " oops {", "no log object"), (lambda t: "oops" + t, "no log object")])
def test_a_long_file_is_bad_from_some_place_on(spark, tmp_path, edit, error):
    text = edit(json.dumps(LONG))
    with small_blocks(spark):
        rows = json_logs.read_json_files(spark, write(tmp_path, "a.json", text)).orderBy("src_row").collect()
    good, bad = [r for r in rows if r.error is None], [r for r in rows if r.error is not None]
    assert len(bad) == 1 and error in bad[0].error
    one_block = json_logs.read_json_files(spark, write(tmp_path, "a.json", text)).orderBy("src_row").collect()
    assert [r.record for r in good] == [r.record for r in one_block if r.error is None]
    assert [r.src_row for r in bad] == [r.src_row for r in one_block if r.error]


def test_values_keep_their_text(spark, tmp_path):
    path = write(tmp_path, "a.json", '[{"process_id": 12345678901234567890.123, "cmdLine": "\\u00e9"}]')
    assert json_logs.read_json_files(spark, path).first().record == '{"process_id": 12345678901234567890.123, "cmdLine": "\\u00e9"}'
    assert load_logs(spark, path).first().process_id == load_logs(spark, path, "lines").first().process_id


def test_compressed_files_of_any_layout(spark, tmp_path):
    assert shown(load_logs(spark, write(tmp_path, "a.json.gz", gzip.compress(json.dumps(LOGS).encode())))) == EXPECTED


@pytest.mark.parametrize("layout", ["lines", "files"])
def test_invalid_utf8_is_replaced(spark, tmp_path, layout):
    path = write(tmp_path, "a.json", b'{"process_id": "a\xffb"}')
    assert load_logs(spark, path, layout).first().process_id == "a�b"


def test_several_paths(spark, tmp_path):
    a = write(tmp_path, "a.json", '{"process_id": 1}')
    b = write(tmp_path, "b.json", '{"process_id": 2}')
    paths = [f"{a}/a.json", f"{b}/b.json"]
    for layout in ("lines", "files"):
        assert [r[0] for r in shown(load_logs(spark, paths, layout))] == ["1", "2"]


CSV = '''timestamp,processId,threadId,parentProcessId,userId,processName,eventName,returnValue,sus,evil
129.05,382,382,1,101,sshd,openat,0,1,0
130,383,383,1,101,"a, ""b""",,15,0,1
,384,384,1,101,sshd,openat,0,1,0
131,385,385,1,101,sshd,openat,0,x,0
132,386,386,1,101,sshd,openat,0,1.0,0
133,387,387
134,388, ,1,101,sshd,openat,0, 1 ,0
inf,389,1,1,101,sshd,openat,0,0,0
1d,390,1,1,101,sshd,openat,0,0,0
'''


def test_labelled_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", CSV)
    rows = labelled_csv.labelled_to_logs(labelled_csv.read_labelled_csv(spark, path)).orderBy("src_row").collect()
    assert [(r.timestamp, r.process_id, r.thread_id, r.cmd_line, r.event_type, r.return_value, r.is_suspicious, r.is_evil)
            for r in rows] == [
        (129.05, "382", "382", "sshd", "openat", "0", 1, 0),
        (130.0, "383", "383", 'a, "b"', None, "15", 0, 1),
        (134.0, "388", None, "sshd", "openat", "0", 1, 0),
        (float("inf"), "389", "1", "sshd", "openat", "0", 0, 0),
    ]


def test_labelled_csv_missing_columns_take_defaults(spark, tmp_path):
    path = write(tmp_path, "a.csv", "processId,evil\n5,1\n")
    row = labelled_csv.labelled_to_logs(labelled_csv.read_labelled_csv(spark, path)).first()
    assert (row.timestamp, row.event_type, row.process_id, row.is_suspicious, row.is_evil) == (0.0, "UNKNOWN", "5", 0, 1)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", "timestamp,processId,sus,evil\n1,5,1,0\n")
    write(tmp_path, "b.csv", "evil,sus,processId,timestamp\n0,1,6,2\n")
    write(tmp_path, "c.csv", "processId,evil,eventName\n7,1,open\n")
    path = write(tmp_path, "d.csv", "timestamp,processId,sus,evil\n4,8,0,1\n")
    rows = labelled_csv.labelled_to_logs(labelled_csv.read_labelled_csv(spark, path)).orderBy("process_id").collect()
    assert [(r.timestamp, r.process_id, r.event_type, r.is_suspicious, r.is_evil) for r in rows] == [
        (1.0, "5", "UNKNOWN", 1, 0), (2.0, "6", "UNKNOWN", 1, 0), (0.0, "7", "open", 0, 1), (4.0, "8", "UNKNOWN", 0, 1)]


def test_labelled_splits_written_as_json_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("labelled_training_data.csv", "labelled_validation_data.csv", "labelled_testing_data.csv"):
        write(folder, name, CSV)
    logs = labelled_csv.read_labelled_splits(spark, str(folder))
    out = str(tmp_path / "out")
    write_logs(logs, out)
    text = spark.read.text(out)
    assert {r.split for r in text.select("split").distinct().collect()} == {"Training", "Validation", "Testing"}
    lines = [json.loads(r.value) for r in text.filter("split = 'Testing'").collect()]
    second = next(x for x in lines if x["process_id"] == "383")
    assert second == {"timestamp": 130.0, "thread_id": "383", "process_id": "383", "parent_process_id": "1",
                      "cmdLine": 'a, "b"', "user_id": "101", "return_value": "15", "is_suspicious": 0, "is_evil": 1}


def event(kind="EVENT_OPEN", record="RECORD_EVENT", **datum):
    return {"type": record, "datum": {"type": kind, **datum}}


EVENTS = [
    event(timestampNanos=5, threadId="t1", predicateObjectPath="/etc/x",
          properties={"cmdLine": "cat", "remoteAddress": "1.2.3.4", "remotePort": "80"}),
    event("EVENT_MMAP", threadId="t1"),
    event(record="RECORD_HOST"),
    event("EVENT_FORK", properties=None),
]


def archive(events):
    return gzip.compress("\n".join(json.dumps(e) for e in events).encode())


def test_archives(spark, tmp_path):
    write(tmp_path, "host.bin.3.gz", archive(EVENTS))
    write(tmp_path, "host.bin.16.gz", archive(EVENTS[:1]))
    write(tmp_path, "host.bin.99.gz", b"not gzip")
    path = write(tmp_path, "notes.txt", "x")
    decoded = archives.read_archives(spark, path, archives.decode_json_gzip)
    logs = archives.extract_logs(archives.parse_events(json_logs.good_records(decoded)))
    rows = [(r.split, r.timestamp_ns, r.event_type, r.thread_id, r.cmd_line, r.file_path, r.remote_ip, r.remote_port)
            for r in logs.orderBy("src_file", "src_row").collect()]
    full = (5, "EVENT_OPEN", "t1", "cat", "/etc/x", "1.2.3.4", "80")
    assert rows == [("Validation", *full), ("Training", *full),
                    ("Training", 0, "EVENT_FORK", "UNKNOWN", None, None, None, None)]
    counts = {(r.split, r.n_logs) for r in archives.split_counts(logs).collect()}
    assert counts == {("Training", 2), ("Validation", 1)}
    assert json_logs.file_errors(decoded).count() == 1


def test_extraction_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("host.bin.3.gz", archive(EVENTS)), ("host.bin.36.gz", archive(EVENTS[:1])),
                       ("host.bin.99.gz", archive(EVENTS)), ("host.bin.4.gz", gzip.compress(b'{"type": "x"}\n{"a'))):
        write(folder, name, data)
    out = str(tmp_path / "out")
    counts, errors = jobs.extract_archives(spark, str(folder), out, archives.decode_json_gzip)
    assert {(r.split, r.n_logs) for r in counts.collect()} == {("Training", 2), ("Testing", 1)}
    assert [r.src_file.rsplit("/", 1)[1] for r in errors.collect()] == ["host.bin.4.gz"]
    text = spark.read.text(out).filter("split = 'Testing'").first().value
    assert json.loads(text) == {"timestamp_ns": 5, "event_type": "EVENT_OPEN", "thread_id": "t1", "cmdLine": "cat",
                                "file_path": "/etc/x", "remote_ip": "1.2.3.4", "remote_port": "80"}


def test_csv_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.csv", CSV)
    counts = jobs.convert_labelled_csv(spark, str(folder), str(tmp_path / "out"), {"Training": "a.csv"})
    assert [(r.split, r.n_logs) for r in counts.collect()] == [("Training", 4)]
    logs = jobs.load_logs(spark, str(tmp_path / "out"), "lines").collect()
    assert sorted(r.process_id for r in logs) == ["382", "383", "388", "389"]


def test_event_exports_are_read_natively(spark, tmp_path):
    path = write(tmp_path, "host.json.gz", archive(EVENTS))
    logs = archives.extract_logs(json_logs.accepted(archives.read_event_exports(spark, path)))
    assert logs.count() == 2


def test_all_kept_event_types(spark, tmp_path):
    from tracehold.functions.fixed_values import KEPT_EVENT_TYPES
    path = write(tmp_path, "host.bin.1.gz", archive([event(k) for k in KEPT_EVENT_TYPES]))
    decoded = archives.read_archives(spark, path, archives.decode_json_gzip)
    logs = archives.extract_logs(archives.parse_events(json_logs.good_records(decoded)))
    assert len(KEPT_EVENT_TYPES) == 10 and logs.count() == 10


def test_avro_decoder_is_reported_when_missing(spark, tmp_path):
    path = write(tmp_path, "host.bin.1.gz", gzip.compress(b"x"))
    decoded = archives.read_archives(spark, path)
    assert json_logs.good_records(decoded).count() == 0
    assert json_logs.file_errors(decoded).count() == 1


def test_bytes_to_text(spark):
    from pyspark.sql import functions as F
    from tracehold.functions.text import bytes_to_text
    frame = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"\xff\x01"),)], "b binary")
    assert [r[0] for r in frame.select(bytes_to_text(F.col("b"))).collect()] == ["abc", "ff01"]
    marked = [(json.dumps({"v": v}, default=archives._marked, separators=(",", ":")),) for v in (b"abc", b"\xff\x01", "x")]
    values = spark.createDataFrame(marked, "j string").select(F.get_json_object("j", "$.v").alias("v"))
    assert [r[0] for r in values.select(archives.text_of_binary(F.col("v"))).collect()] == ["abc", "ff01", "x"]
