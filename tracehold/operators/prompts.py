"""Prompt rendering as columns, and batch calls of a user-supplied model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import Empty, Queue
from string import Formatter
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracehold.session import materialize

Client = Callable[[list[dict]], str]


@dataclass(frozen=True)
class Template:
    """System text and user text with ``{field}`` places."""

    system: str
    user: str


# Default wording; every function that renders a prompt takes other templates.
VERDICT = Template(
    "You review Linux security events. Judge each event by its whole execution chain: an "
    "ordinary tool started by an odd parent, or one that reaches an outside address, points "
    "to an attack. Use MITRE ATT&CK names.",
    "<event>\n{log}\n</event>\n<provenance>\n{context}\n</provenance>\n"
    "Begin with Benign or Malicious. For the latter add tactic and technique. Then describe the "
    "activity in two sentences.",
)
ANALYSIS = Template(
    "You are a terse security analyst. Answer in two sentences: first the root cause, then "
    "the MITRE ATT&CK tactic and technique.",
    '<provenance process="{pid}">\n{context}\n</provenance>\nWhat happened, and by which technique?',
)
STRATEGY = Template(
    "You lead incident response. Answer with three bullet points of at most ten words, each an "
    "immediate containment step.",
    "<analysis>\n{analysis}\n</analysis>\nWhich three steps contain this?",
)
COMMANDS = Template(
    "You are a Linux engineer. Answer with at most three plain Bash commands and nothing else.",
    '<steps process="{pid}">\n{strategy}\n</steps>\nWhich commands carry them out?',
)
AUDIT = Template(
    "You audit incident-response commands. Remove anything that deletes the root file system, "
    "wipes databases or stops the server. Signals may go to the named process only. Answer with "
    "the final Bash commands and nothing else; repeat safe commands unchanged.",
    "<analysis>\n{analysis}\n</analysis>\n<commands>\n{commands}\n</commands>\nWhich of them may run?",
)


def fill(template: str, fields: Mapping[str, Column]) -> Column:
    """The template as a column; field values are data, never read as templates."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def messages(template: Template, **fields: Column) -> Column:
    """Array of (role, content): the system message and the user message."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(template.system)), message("user", fill(template.user, fields))
    )


def log_text(*columns: str) -> Column:
    """The log's non-NULL fields as indented JSON."""
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def _within(seconds: float | None, action: Callable[[], str]) -> str:
    """The action's result; TimeoutError if it takes longer. What hangs is left behind in a daemon thread."""
    if seconds is None:
        return action()
    results: Queue = Queue()

    def run() -> None:
        try:
            results.put((action(), None))
        except Exception as failure:  # noqa: BLE001 - raised again by the caller
            results.put((None, failure))

    Thread(target=run, daemon=True).start()
    try:
        answer, failure = results.get(timeout=seconds)
    except Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if failure is not None:
        raise failure
    return answer


def call_model(
    requests: DataFrame,
    connect: Callable[[], Client],
    key: str = "request_id",
    tasks: int | None = None,
    concurrency: int = 4,
    attempts: int = 2,
    timeout: float | None = None,
) -> DataFrame:
    """Send (key, messages) rows to a model: (key, response, error, seconds).

    ``connect`` runs once per task and returns the client; calls of one task
    overlap up to ``concurrency``. A call that keeps failing gives a row with
    ``error``; so does one that takes more than ``timeout`` seconds. Requests are spread over a fixed number of tasks, since a few slow
    calls weigh more than many rows. Calls cost money and may have effects, so
    store the result (``materialize``) before using it twice.
    """
    tasks = tasks or requests.sparkSession.sparkContext.defaultParallelism
    key_type = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None

        def ask(chat) -> tuple[str | None, str | None, float]:
            start, problem = time.monotonic(), None
            for _ in range(attempts):
                try:
                    answer = _within(timeout, lambda: client([dict(m) for m in chat]))
                    return answer, None, time.monotonic() - start
                except Exception as failure:  # noqa: BLE001 - reported as a row
                    problem = f"{type(failure).__name__}: {failure}"
            return None, problem, time.monotonic() - start

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                client = client or connect()
                answers = list(pool.map(ask, batch["messages"]))
                out = pd.DataFrame(answers, columns=["response", "error", "seconds"])
                out.insert(0, key, batch[key].to_numpy())
                yield out

    def as_dicts(frame: DataFrame) -> DataFrame:
        pairs = F.transform(
            "messages",
            lambda m: F.create_map(F.lit("role"), m["role"], F.lit("content"), m["content"]),
        )
        return frame.select(key, pairs.alias("messages"))

    spread = as_dicts(requests).repartition(tasks, key)
    return spread.mapInPandas(run, f"{key} {key_type}, response string, error string, seconds double")


def ask_once(
    rows: DataFrame, key: str, prompt: Column, connect: Callable[[], Client], name: str, store=None, **options
) -> DataFrame:
    """Add column ``name`` (the model's answer to ``prompt``) to rows unique by ``key``.

    Rows that already carry an ``error`` are not sent. Adds to ``seconds``. With a ``store``
    (``answers.AnswerStore``) equal prompts are one call, and none if it was answered before.
    """
    requests = rows.filter(F.col("error").isNull()).select(key, prompt.alias("messages"))
    told = store.answer(requests, connect, key, **options) if store else call_model(requests, connect, key, **options)
    answers = materialize(told, f"answers-{name}")
    answers = answers.withColumnsRenamed({"response": name, "error": "_error", "seconds": "_s"})
    return (
        rows.join(answers, key, "left")
        .withColumn("error", F.coalesce("error", "_error"))
        .withColumn("seconds", F.col("seconds") + F.coalesce("_s", F.lit(0.0)))
        .drop("_error", "_s")
    )
