"""Host logs and model answers derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.functions.text import once


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _choice(index: Column, values: list[str | None]) -> Column:
    """values[index], native and without a lookup join."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def process_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical logs from the ``events`` table; ``pos`` is the input position."""
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("pos"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("e"),
        once(F.get_json_object("props", "$.k").cast("long")).alias("k"),
    )
    u, e, k = F.col("u"), F.col("e"), F.col("k")
    text = lambda column: column.cast("string")
    none = F.lit(None).cast("string")
    parent = (
        F.when((u < 5) | (k % 10 == 0), none)
        .when(k % 10 == 1, F.lit("None"))
        .when(k % 10 == 2, text(9000 + u % 7))
        .when(k % 10 == 3, text((u * 7 + 3) % 15))
        .otherwise(text(F.expr("u div 3")))
    )
    args = F.when(k % 4 == 0, none).when(k % 4 == 1, F.lit("")).otherwise(
        F.concat(
            F.lit("-c "),
            F.when(k % 7 == 0, "wget x").when(k % 7 == 1, "sync").otherwise("run"),
        )
    )
    names = ["bash", "sshd", "python3", "curl", "ls", "tsm", "cron", None]
    kinds = F.create_map(*[F.lit(x) for pair in (
        ("signup", "EVENT_FORK"), ("click", "EVENT_OPEN"), ("purchase", "EVENT_WRITE"),
        ("view", "EVENT_CONNECT"), ("error", "EVENT_MMAP"),
    ) for x in pair])
    touches_file = e.isin("click", "purchase", "error") & (k % 5 != 0)
    return events.select(
        "pos",
        (F.col("us") / 1e6).alias("timestamp"),
        (F.col("us") * 1000).alias("timestamp_ns"),
        kinds[e].alias("event_type"),
        text(u).alias("process_id"),
        parent.alias("parent_process_id"),
        none.alias("thread_id"),
        _choice(k % 8, names).alias("process_name"),
        args.alias("args"),
        none.alias("cmd_line"),
        text(1000 + u % 5).alias("user_id"),
        none.alias("return_value"),
        F.when(touches_file, F.concat(F.lit("/var/f"), text(k % 20))).alias("file_path"),
        F.when((e == "view") & (k % 4 != 0), F.concat(F.lit("10.0.0."), text(k % 16))).alias("remote_ip"),
        F.when((e == "view") & (k % 3 != 0), text(1000 + k)).alias("remote_port"),
        (k >= 80).cast("int").alias("is_suspicious"),
        (k >= 90).cast("int").alias("is_evil"),
        (k / 100.0).alias("base"),
    )


def nested_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same events in the nested shape of the kernel-event archives."""
    logs = process_logs(spark, folder)
    pairs = F.map_filter(
        F.create_map(
            F.lit("cmdLine"), "args", F.lit("remoteAddress"), "remote_ip",
            F.lit("remotePort"), "remote_port",
        ),
        lambda _, value: value.isNotNull(),
    )
    return logs.select(
        "pos",
        F.when(F.col("pos") % 11 == 0, "RECORD_HOST").otherwise("RECORD_EVENT").alias("type"),
        F.struct(
            F.col("event_type").alias("type"),
            F.when(F.col("pos") % 13 != 0, F.col("timestamp_ns")).alias("timestampNanos"),
            F.when(F.col("pos") % 17 != 0, F.col("process_id")).alias("threadId"),
            F.col("file_path").alias("predicateObjectPath"),
            F.when(F.col("pos") % 19 != 0, pairs).alias("properties"),
        ).alias("datum"),
    )


def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same events as labelled CSV rows, all text, some of them broken."""
    logs = process_logs(spark, folder)
    pos = F.col("pos")
    return logs.select(
        "pos",
        F.when(pos % 23 == 0, "").when(pos % 29 == 0, "n/a")
        .otherwise(F.expr("timestamp_ns div 1000").cast("string")).alias("timestamp"),
        F.when(pos % 31 == 0, "").when(pos % 37 == 0, " ")
        .otherwise(F.col("event_type")).alias("eventName"),
        F.col("process_id").alias("threadId"),
        F.col("process_id").alias("processId"),
        F.col("parent_process_id").alias("parentProcessId"),
        F.concat(
            F.coalesce("process_name", F.lit("")), F.when(pos % 41 == 0, ', "x"').otherwise("")
        ).alias("processName"),
        F.col("user_id").alias("userId"),
        F.lit("0").alias("returnValue"),
        F.when(pos % 43 == 0, "1.0").otherwise(F.col("is_suspicious").cast("string")).alias("sus"),
        F.when(pos % 47 == 0, "x").otherwise(F.col("is_evil").cast("string")).alias("evil"),
    )


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of three models to the ``labels`` rows: (doc_id, model, is_evil, text, error)."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("is_evil"))
    rows = labels.withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    texts = [
        "Benign activity.", "Verdict: MALICIOUS. T1059.", "malicious, not benign", "inconclusive",
    ]
    d, m = F.col("doc_id"), F.col("m")
    return rows.select(
        "doc_id",
        F.concat(F.lit("m"), m.cast("string")).alias("model"),
        "is_evil",
        _choice((d * 3 + m + F.col("is_evil")) % 4, texts).alias("text"),
        F.when((d + m) % 29 == 0, "timeout").alias("error"),
    )
