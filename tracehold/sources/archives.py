"""Kernel-event archive source: per-file compressed event containers.

A gzip file cannot be split, so the unit of work is the file: one task decodes
it, the rows are plain columns from there on.
"""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import bytes_to_text
from tracehold.sources.json_logs import decode_files, parse_json, read_json_lines

_TEXT = T.StringType()
EVENT_SCHEMA = T.StructType([
    T.StructField("type", _TEXT),
    T.StructField("datum", T.StructType([
        T.StructField("type", _TEXT),
        T.StructField("timestampNanos", T.LongType()),
        T.StructField("threadId", _TEXT),
        T.StructField("predicateObjectPath", _TEXT),
        T.StructField("properties", T.MapType(_TEXT, _TEXT)),
    ])),
])


def _marked(value: object) -> object:
    """What JSON has no form for: binary values go as base64 under a mark, others as text."""
    if isinstance(value, bytes):
        return {fv.BINARY_MARK: base64.b64encode(value).decode("ascii")}
    return str(value)


def text_of_binary(column: Column) -> Column:
    """The column, with a marked binary value as text (or hex where it is not valid UTF-8)."""
    mark = f'{{"{fv.BINARY_MARK}":"'
    return F.when(
        column.startswith(mark), bytes_to_text(F.unbase64(F.get_json_object(column, f"$.{fv.BINARY_MARK}")))
    ).otherwise(column)


def decode_avro_gzip(stream: BinaryIO) -> Iterator[str]:
    """JSON text of each record of a gzip-wrapped Avro container (needs ``fastavro``)."""
    import fastavro

    with gzip.open(stream) as plain:
        for record in fastavro.reader(plain):
            yield json.dumps(record, default=_marked, separators=(",", ":"))


def decode_json_gzip(stream: BinaryIO) -> Iterator[str]:
    """JSON text of each line of a gzip-wrapped JSON-lines export."""
    with gzip.open(stream) as plain:
        for line in plain:
            if line.strip():
                yield json.dumps(json.loads(line))


def file_number(path: Column, pattern: str = fv.ARCHIVE_NUMBER_PATTERN) -> Column:
    return F.regexp_extract(path, pattern, 1).try_cast("int")


def split_of(
    path: Column, numbers: dict | None = None, pattern: str = fv.ARCHIVE_NUMBER_PATTERN
) -> Column:
    """Split that a file belongs to by its number; NULL for files in no split.

    The assignment is a fixed list of a few numbers, so it is an expression and
    not a join.
    """
    number = file_number(path, pattern)
    numbers = numbers or fv.SPLIT_FILE_NUMBERS
    return F.coalesce(*[F.when(number.isin(*ns), F.lit(split)) for split, ns in numbers.items()])


def read_archives(
    spark: SparkSession,
    path,
    decode: Callable[[BinaryIO], Iterator[str]] = decode_avro_gzip,
    pattern: str = "*.gz",
) -> DataFrame:
    """Decoded records (JSON text) of all archives, with an ``error`` row per bad file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return decode_files(files, decode)


def read_event_exports(spark: SparkSession, path) -> DataFrame:
    """JSON-lines exports (``.gz`` or plain), decompressed by the reader itself."""
    return parse_json(read_json_lines(spark, path), EVENT_SCHEMA)


def read_avro_events(spark: SparkSession, path) -> DataFrame:
    """Plain (not gzip-wrapped) Avro containers, read in splits by Spark's Avro module.

    The module is an external one (``spark-avro``) and must be on the class path.
    """
    rows = spark.read.format("avro").load(path)
    return rows.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        "type",
        "datum",
    )


def parse_events(records: DataFrame) -> DataFrame:
    return parse_json(records, EVENT_SCHEMA)


def keep_events(events: DataFrame) -> DataFrame:
    """Only event records of the kept kinds."""
    return events.filter(
        (F.col("type") == fv.RECORD_KIND) & F.col("datum.type").isin(*fv.KEPT_EVENT_TYPES)
    )


def flatten_events(events: DataFrame) -> DataFrame:
    """Nested event records to flat log columns."""
    flat = {"type", "datum", "rejected"}
    value = F.col("datum.properties")
    return events.select(
        *[c for c in events.columns if c not in flat],
        F.coalesce("datum.timestampNanos", F.lit(0)).alias("timestamp_ns"),
        F.col("datum.type").alias("event_type"),
        F.coalesce(text_of_binary(F.col("datum.threadId")), F.lit(fv.UNKNOWN_PROCESS)).alias("thread_id"),
        text_of_binary(value["cmdLine"]).alias("cmd_line"),
        text_of_binary(F.col("datum.predicateObjectPath")).alias("file_path"),
        text_of_binary(value["remoteAddress"]).alias("remote_ip"),
        text_of_binary(value["remotePort"]).alias("remote_port"),
    )


def extract_logs(events: DataFrame, pattern: str = fv.ARCHIVE_NUMBER_PATTERN) -> DataFrame:
    """Filter, flatten and assign splits."""
    split = split_of(F.col("src_file"), pattern=pattern)
    return flatten_events(keep_events(events)).withColumn("split", split)


def split_counts(logs: DataFrame) -> DataFrame:
    """Rows per split and file."""
    return logs.groupBy("split", "src_file").agg(F.count("*").alias("n_logs"))
