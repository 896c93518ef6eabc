"""Log, alert and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import two_decimals

# Field names of the written log files, by column.
WRITTEN_NAMES = {"cmd_line": "cmdLine", "process_name": "processName"}
# Columns that say where a log was read, not what it holds.
POSITION_COLUMNS = ("src_file", "src_block", "src_row", "pos")


def write_logs(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder per split; all columns but input positions; NULL fields are left out."""
    columns = [F.col(c).alias(WRITTEN_NAMES.get(c, c)) for c in logs.columns if c not in (*POSITION_COLUMNS, "split")]
    split = ["split"] if "split" in logs.columns else []
    writer = logs.select(*columns, *split).write.mode(mode).option("ignoreNullFields", "true")
    (writer.partitionBy(*split) if split else writer).json(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.write.mode(mode).parquet(path)


def matrix_rows(metrics: DataFrame) -> DataFrame:
    """Per-model metrics (percentages) as the texts of the comparison table."""
    name, accuracy, precision, recall, f1, seconds = fv.MATRIX_HEADER
    return metrics.select(
        F.col("model").alias(name),
        two_decimals(F.col("accuracy")).alias(accuracy),
        two_decimals(F.col("precision")).alias(precision),
        two_decimals(F.col("recall")).alias(recall),
        two_decimals(F.col("f1")).alias(f1),
        F.round("seconds", 2).cast("string").alias(seconds),
    )


def write_matrix(metrics: DataFrame, path: str, model_order: list[str] | None = None) -> None:
    """The comparison table as one CSV file (one row per model, so one task is enough)."""
    rows = matrix_rows(metrics)
    name = fv.MATRIX_HEADER[0]
    key = F.col(name)
    if model_order:
        key = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col(name))
    rows.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").csv(path, header=True)
