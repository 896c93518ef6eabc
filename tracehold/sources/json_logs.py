"""JSON log sources.

Three readers, by what the files look like:

* ``read_json_lines``   one object per line (also as lines of an array); splittable.
* ``read_json_objects`` pretty-printed objects, back to back or in an indented
  array; splittable at the closing brace's line.
* ``read_json_files``   any layout (arrays, objects on one line, Python literals,
  broken tails); all blocks of a file are cut at once, each task holds one object at a time.

None limits the size of a file. Each returns text records with their input
position (``src_file``, ``src_block``, ``src_row``); ``parse_json`` turns the text
into columns. Input position is what "last one wins" and "first N logs" order by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracehold.functions.text import once
from tracehold.session import materialize
from tracehold.sources.json_blocks import COMPRESSED, ObjectCutter, cut_files

INPUT_ORDER = ("src_file", "src_block", "src_row")

# Every field as text: ids come as numbers or strings, args as text or list.
RAW_LOG_FIELDS = (
    "timestamp", "timestamp_ns", "event_type",
    "process_id", "processId", "parent_process_id", "parentProcessId",
    "thread_id", "threadId", "user_id", "userId",
    "processName", "args", "cmdLine", "return_value",
    "file_path", "remote_ip", "remote_port", "is_suspicious", "is_evil",
)
RAW_LOG_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_LOG_FIELDS])

DECODED = (
    "src_file string, src_block long, src_row long, record string, error string"
)
#: Not blank, and not only the marks that an array has between its objects.
_MORE_THAN_MARKS = r"[^\s,\[\]]"
_SPACE = " \t\n\x0b\f\r"


def _text_records(texts: DataFrame, row: Column) -> DataFrame:
    return texts.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        row.alias("src_row"),
        F.make_valid_utf8("value").alias("record"),
    )


def read_json_lines(spark: SparkSession, path) -> DataFrame:
    """One record per non-blank line."""
    texts = spark.read.text(path)
    return _text_records(texts, F.monotonically_increasing_id()).filter(F.col("record").rlike(_MORE_THAN_MARKS))


def stream_json_lines(spark: SparkSession, path, **options) -> DataFrame:
    """The streaming form of ``read_json_lines``. Row numbers exist per batch only,
    so ``src_row`` is 0 here and set where a batch needs it."""
    texts = spark.readStream.options(**options).text(path)
    return _text_records(texts, F.lit(0).cast("long")).filter(F.col("record").rlike(_MORE_THAN_MARKS))


def read_json_objects(spark: SparkSession, path, object_end: str = "\n}") -> DataFrame:
    """One record per pretty-printed object.

    Raw line breaks cannot occur inside JSON strings, so a line that starts with
    the closing brace at the objects' own indent can only end an object. For an
    indented array pass the indented brace, e.g. ``"\\n  }"``. What stands after a
    file's last closing brace is a record as it is (and will be rejected).
    """
    texts = spark.read.text(path, lineSep=object_end)
    pieces = _text_records(texts, F.monotonically_increasing_id())
    # a file whose pieces, each with an end, are longer than the file lacks the last end
    size = F.octet_length("value") + len(object_end.encode())
    files = texts.select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("src_block"), F.monotonically_increasing_id().alias("src_row"), size.alias("_bytes"),
    ).groupBy("src_file", "_size", "src_block").agg(F.sum("_bytes").alias("_bytes"), F.max("src_row").alias("src_row")).groupBy(
        "src_file", "_size").agg(F.sum("_bytes").alias("_bytes"), F.max(F.struct("src_block", "src_row")).alias("_at"))
    whole = F.lower("src_file").rlike("(" + "|".join(re.escape(x) for x in COMPRESSED) + ")$")
    open_ends = materialize(files.where((F.col("_bytes") > F.col("_size")) & ~whole).select(
        "src_file", "_at.src_block", "_at.src_row", F.lit("").alias("_end")), "open-ends")
    # at most one row per file; where all files are whole, no piece is looked up
    ended = pieces.join(open_ends, list(INPUT_ORDER), "left") if open_ends.limit(1).count() else pieces.withColumn("_end", F.lit(None).cast("string"))
    return (
        ended.withColumn("record", F.regexp_replace("record", r"^[\s,\[\]]+", ""))
        .filter((F.col("record") != "") & ~F.col("record").rlike(r"^\s+$"))
        .select(*INPUT_ORDER, F.concat("record", F.coalesce("_end", F.lit(object_end))).alias("record"))
    )


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"src_file": pa.string(), "src_block": pa.int64(), "src_row": pa.int64(), "record": pa.string(), "error": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def read_json_files(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """Records of files in any layout, with an ``error`` row for a file that is bad from some place on.

    Files are cut at closing braces by the text reader, and all blocks of a file are cut into objects at
    once (``json_blocks``); nothing longer than an object is held. The end of an uncompressed file is told
    exactly; a compressed one that lacks nothing but its last brace counts as whole. Records keep the
    text of their file if it is JSON; Python literals become JSON. ``src_row`` numbers the objects of a file.
    """
    texts = spark.read.option("pathGlobFilter", pattern).text(path, lineSep="}")
    pieces = texts.select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"), F.col("value").cast("binary").alias("piece"),
        F.col("_metadata.file_size").alias("size"))
    return cut_files(pieces).select("src_file", F.lit(0).cast("long").alias("src_block"), "src_row", "record", "error")


def decode_files(files: DataFrame, decode: Callable[[BinaryIO], Iterator[str]], rows_per_batch: int = 5000) -> DataFrame:
    """Run a decoder over the files of a ``binaryFile`` frame, one task per file.

    The decoder gets an open stream and yields records; neither the file nor its records are
    held. Files are opened by path on the executors. Yields one row per record, and one row with
    ``error`` set for a file that fails, so that a bad file never fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column(0).to_pylist():
                count, rows = 0, []
                try:
                    system, inside = FileSystem.from_uri(path)
                    with system.open_input_stream(inside, compression=None) as stream:
                        for record in decode(stream):
                            rows.append((path, 0, count, record, None))
                            count += 1
                            if len(rows) == rows_per_batch:
                                yield _as_batch(rows)
                                rows = []
                except Exception as problem:  # noqa: BLE001 - reported as a row
                    rows.append((path, 0, count, None, f"{type(problem).__name__}: {problem}"))
                yield _as_batch(rows)

    return files.select(F.replace("path", F.lit("file:/"), F.lit("file:///")).alias("path")).mapInArrow(run, DECODED)


def file_errors(decoded: DataFrame) -> DataFrame:
    """(src_file, error) of the files that failed."""
    return decoded.filter(F.col("error").isNotNull()).select("src_file", "error")


def good_records(decoded: DataFrame, whole_files_only: bool = False) -> DataFrame:
    """The records; with ``whole_files_only`` none from a file that failed.

    Reads ``decoded`` twice then, so store it first (``materialize``).
    """
    rows = decoded.filter(F.col("error").isNull()).drop("error")
    if whole_files_only:
        rows = rows.join(file_errors(decoded).select("src_file"), "src_file", "left_anti")
    return rows


def parse_json(records: DataFrame, schema: T.StructType = RAW_LOG_SCHEMA) -> DataFrame:
    """Input position, the schema's columns, and ``rejected`` (text that is no object)."""
    # Parsed as an array of one, so that text after the object makes it invalid; the
    # parser alone would stop at the object's end and drop the rest unseen. Around it
    # stand what parts the objects of an array.
    begun = F.ltrim("record", F.lit(_SPACE + ",["))
    body = F.rtrim(begun, F.lit(_SPACE + ",]"))
    values = F.from_json(
        F.concat(F.lit("["), body, F.lit("]")),
        T.ArrayType(schema),
        {"allowSingleQuotes": "false"},
    )
    is_object = begun.startswith("{")
    return records.select(
        *INPUT_ORDER, "record", once(F.when(is_object, values)).alias("_values")
    ).select(
        *INPUT_ORDER,
        "record",
        F.when(F.size("_values") == 1, F.col("_values")[0]).alias("p"),
    ).select(
        *INPUT_ORDER,
        *[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields],
        F.when(F.col("p").isNull(), F.col("record")).alias("rejected"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejected").isNull()).drop("rejected")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejected").isNotNull()).select(*INPUT_ORDER, "rejected")


_READERS = {"lines": read_json_lines, "objects": read_json_objects}


def whole_or_fail(decoded: DataFrame) -> DataFrame:
    """The records; the job fails at a file that was not read whole."""
    problem = F.raise_error(F.concat("src_file", F.lit(" was not read whole: "), "error"))
    return decoded.filter(F.when(F.col("error").isNotNull(), problem.cast("boolean")).otherwise(F.lit(True))).drop("error")


def read_logs(spark: SparkSession, path, layout: str = "files", partial: bool = False) -> DataFrame:
    """Raw log columns of one path or several, in the named layout.

    Layout ``files`` takes any. A file that cannot be read whole fails the job unless ``partial``
    allows its good part alone; ``file_errors`` of ``read_json_files`` names such files. Lines and
    objects that are no log are left out; ``rejects`` of ``parse_json`` shows them.
    """
    if layout in _READERS:
        return accepted(parse_json(_READERS[layout](spark, path)))
    if layout != "files":
        raise ValueError(f"layout is one of {sorted(_READERS)} or 'files', not {layout!r}")
    decoded = read_json_files(spark, path)
    return accepted(parse_json(good_records(decoded) if partial else whole_or_fail(decoded)))
