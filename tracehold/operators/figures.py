"""Row counts and seconds of a job's stages, gathered while the job runs.

Counts are observed on rows as they pass: no stage is read again to be counted. What comes back is one number
per measure, so nothing here grows with the data.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tracehold.session import list_folder, write_text

SCHEMA = "stage string, measure string, value double"
STREAM_SCHEMA = "query string, batch long, stage string, measure string, value double"


class Figures:
    """Measures of the stages of one batch run."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.rows: list[tuple[str, str, float]] = []
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, frame: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """The frame, with aggregates of its rows taken by the first action that runs over it."""
        seen = Observation()
        self._watched.append((stage, seen))
        return frame.observe(seen, *[column.alias(name) for name, column in measures.items()])

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        """Seconds of what runs meanwhile. It must hold an action over every frame watched since the last one."""
        start = time.monotonic()
        try:
            yield
        except BaseException:
            self._watched.clear()  # an action that failed has no measures
            raise
        self.rows.append((stage, "seconds", round(time.monotonic() - start, 2)))
        while self._watched:
            name, seen = self._watched.pop(0)
            self.rows += [(name, measure, float(value or 0)) for measure, value in seen.get.items()]

    def table(self) -> DataFrame:
        """(stage, measure, value): a row per measure so far."""
        return self.spark.createDataFrame(self.rows, SCHEMA)


def watch_stream(frame: DataFrame, stage: str, **measures: Column) -> DataFrame:
    """A streaming frame whose rows are measured batch by batch; ``StreamFigures`` writes the measures down."""
    return frame.observe(stage, *[column.alias(name) for name, column in measures.items()])


class StreamFigures(StreamingQueryListener):
    """Writes the measures and seconds of every micro-batch into a folder: one small file per batch.

    Add it with ``spark.streams.addListener``. A batch that is run again replaces its file, and nothing
    is kept in memory. ``queries`` limits it to queries of these names.
    """

    def __init__(self, spark: SparkSession, path: str, queries: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.queries = spark, path.rstrip("/"), queries

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.queries and progress.name not in self.queries:
            return
        measures = [("batch", "rows", progress.numInputRows),
                    ("batch", "seconds", progress.durationMs.get("triggerExecution", 0) / 1000)]
        for stage, row in progress.observedMetrics.items():
            measures += [(stage, measure, value) for measure, value in row.asDict().items()]
        name = progress.name or str(progress.id)
        lines = [json.dumps({"query": name, "batch": progress.batchId, "stage": s, "measure": m, "value": float(v or 0)})
                 for s, m, v in measures]
        write_text(self.spark, f"{self.path}/{progress.id}-{progress.batchId}.json", "\n".join(lines))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_stream_figures(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, stage, measure, value) of all batches so far."""
    if not list_folder(spark, path):
        return spark.createDataFrame([], STREAM_SCHEMA)
    return spark.read.schema(STREAM_SCHEMA).json(path)
