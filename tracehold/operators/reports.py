"""Verdict and incident-report chains, report text, command audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import strip, strip_fences
from tracehold.operators import prompts as p
from tracehold.session import materialize

# What the command audit looks for, per line.
ROOT_DELETE_PATTERN = (
    r"(^|[;&|\s])rm\s+(--?[\w-]+\s+)*(-\w*[rR]\w*|--recursive)\s+(--?[\w-]+\s+)*/\*?(\s|;|&|\||$)"
)
SHUTDOWN_PATTERN = r"\b(shutdown|poweroff|reboot|halt)\b|\binit\s+[06]\b"
DATABASE_WIPE_PATTERN = r"(?i)\bdrop\s+(database|schema|table)\b"
KILL_PATTERN = r"(^|[;&|\s])kill\s"
KILL_BY_NAME_PATTERN = r"\b(pkill|killall)\b"
NUMBER_ARGUMENT_PATTERN = r"\s(\d+)"


def verdicts_of(
    rows: DataFrame,
    key: str,
    log: Column,
    connect: Callable[[], p.Client],
    template: p.Template = p.VERDICT,
    **options,
) -> DataFrame:
    """Two-stage chain: rows with ``context`` get the model's ``analysis``."""
    start = materialize(
        rows.withColumn("error", F.lit(None).cast("string")).withColumn("seconds", F.lit(0.0)),
        "verdict-rows",
    )
    prompt = p.messages(template, log=log, context=F.col("context"))
    return p.ask_once(start, key, prompt, connect, "analysis", **options)


def incident_reports(
    contexts: DataFrame, connect: Callable[[], p.Client], **options
) -> DataFrame:
    """Four model stages per process, then the report text.

    ``contexts`` holds one (process_id, context) row per alerted process: the
    prompts depend on nothing else, so each process is asked about once however
    many alerts it raised. A failed stage ends that process's chain with ``error``.
    """
    # Stored first: every stage reads the rows again.
    rows = materialize(
        contexts.withColumn("error", F.lit(None).cast("string")).withColumn("seconds", F.lit(0.0)),
        "report-rows",
    )
    pid = F.col("process_id")

    def stage(frame, template, name, **fields):
        return p.ask_once(
            frame, "process_id", p.messages(template, **fields), connect, name, **options
        )

    rows = stage(rows, p.ANALYSIS, "analysis", pid=pid, context=F.col("context"))
    rows = stage(rows, p.STRATEGY, "strategy", analysis=F.col("analysis"))
    rows = stage(rows, p.COMMANDS, "draft", pid=pid, strategy=F.col("strategy"))
    rows = rows.withColumn("draft", strip_fences(F.col("draft")))
    rows = stage(
        rows, p.AUDIT, "commands", analysis=F.col("analysis"), commands=F.col("draft")
    )
    return (
        rows.withColumn("commands", strip_fences(F.col("commands")))
        .withColumn("unsafe", unsafe_commands(F.col("commands"), pid))
        .withColumn(
            "report",
            F.when(
                F.col("error").isNull(),
                report_text(F.col("context"), F.col("analysis"), F.col("strategy"), F.col("commands")),
            ),
        )
    )


def report_text(context: Column, analysis: Column, strategy: Column, commands: Column) -> Column:
    return F.format_string(fv.REPORT_FORMAT, context, strip(analysis), strip(strategy), strip(commands))


def unsafe_commands(commands: Column, pid: Column) -> Column:
    """Names of the safety rules the commands break, in rule order; empty if none.

    A text check beside the model's own audit. Nothing is ever executed.
    """
    lines = F.split(F.coalesce(commands, F.lit("")), "\n")

    def some(test) -> Column:
        return F.exists(lines, test)

    def kills_other(line: Column) -> Column:
        targets = F.regexp_extract_all(line, F.lit(NUMBER_ARGUMENT_PATTERN), 1)
        return line.rlike(KILL_PATTERN) & F.exists(targets, lambda t: t != pid)

    rules = {
        "root_delete": some(lambda x: x.rlike(ROOT_DELETE_PATTERN)),
        "shutdown": some(lambda x: x.rlike(SHUTDOWN_PATTERN)),
        "database_wipe": some(lambda x: x.rlike(DATABASE_WIPE_PATTERN)),
        "kill_other": some(kills_other),
        "kill_by_name": some(lambda x: x.rlike(KILL_BY_NAME_PATTERN)),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
