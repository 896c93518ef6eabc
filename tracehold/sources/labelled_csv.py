"""Labelled CSV source: header, quoted fields, every column read as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import blank_to_null


#: What a file without the column stands for.
DEFAULTS = {"timestamp": "0", "eventName": fv.UNKNOWN_EVENT, "sus": "0", "evil": "0"}


def files_by_header(spark: SparkSession, path) -> list[list[str]]:
    """The files of one path or several, those with the same header line together."""
    texts = spark.read.text(path)
    files = texts.inputFiles()
    if len(files) < 2:
        return [files]
    lines = texts.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("row"))
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [row.files for row in groups]


def read_labelled_csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Columns named by each file's own header; a column that a file lacks has its default there.

    Splittable unless ``multi_line`` is needed for quoted fields that contain line breaks.
    """
    frames = []
    for files in files_by_header(spark, path):
        rows = spark.read.csv(files or path, header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=False)
        frames.append(rows.select(
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("src_block"),
            F.monotonically_increasing_id().alias("src_row"),
            *[F.col(f"`{name}`") for name in rows.columns],
        ))
    names = list(dict.fromkeys(name for frame in frames for name in frame.columns))
    return reduce(DataFrame.unionAll, [
        frame.select(*[
            F.col(f"`{name}`") if name in frame.columns else F.lit(DEFAULTS.get(name)).cast("string").alias(name)
            for name in names
        ])
        for frame in frames
    ])


def to_double(text: Column) -> Column:
    """Number in the text, NULL if there is none ('1d' and '1f' are not numbers)."""
    return F.when(~text.rlike(r"\d[dDfF]\s*$"), text.try_cast("double"))


def labelled_to_logs(rows: DataFrame) -> DataFrame:
    """Rename and cast to the log schema; drop rows whose time or labels do not parse.

    A missing column takes its default; a blank field becomes NULL. Blank-only
    fields are elided, never defaulted.
    """
    present = set(rows.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in present else F.lit(DEFAULTS.get(name)).cast("string")

    kept = [c for c in ("src_file", "src_block", "src_row", "pos") if c in present]
    logs = rows.select(
        *kept,
        to_double(field("timestamp")).alias("timestamp"),
        blank_to_null(field("eventName")).alias("event_type"),
        blank_to_null(field("threadId")).alias("thread_id"),
        blank_to_null(field("processId")).alias("process_id"),
        blank_to_null(field("parentProcessId")).alias("parent_process_id"),
        blank_to_null(field("processName")).alias("cmd_line"),
        blank_to_null(field("userId")).alias("user_id"),
        blank_to_null(field("returnValue")).alias("return_value"),
        field("sus").try_cast("int").alias("is_suspicious"),
        field("evil").try_cast("int").alias("is_evil"),
    )
    return logs.dropna(subset=["timestamp", "is_suspicious", "is_evil"])


def read_labelled_splits(spark: SparkSession, folder: str, files: dict | None = None) -> DataFrame:
    """The labelled files of a folder with a ``split`` column from the file name."""
    files = files or fv.SPLIT_CSV_FILES
    rows = read_labelled_csv(spark, [f"{folder}/{name}" for name in files.values()])
    split = F.coalesce(
        *[F.when(F.col("src_file").endswith("/" + name), F.lit(s)) for s, name in files.items()]
    )
    return labelled_to_logs(rows).withColumn("split", split)
