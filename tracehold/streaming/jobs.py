"""Structured Streaming: live scoring, tiered triage, running metrics, graph upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracehold.functions import fixed_values as fv
from tracehold.functions.hashing import feature_seed
from tracehold.operators import evaluate, features, graph, prompts, scoring
from tracehold.operators.normalize import canonical_logs
from tracehold.plans.jobs import triage
from tracehold.session import materialize, scratch
from tracehold.sources.id_numbers import IdNumbers
from tracehold.sources.merge_store import MergeStore
from tracehold.sources.json_logs import INPUT_ORDER, accepted, parse_json, stream_json_lines


def stream_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Canonical logs from JSON-lines files as they arrive; malformed lines are skipped.

    Adds ``event_time`` for consumers that need a timestamp. ``options`` go to
    the file source (``maxFilesPerTrigger`` and the like).
    """
    raw = accepted(parse_json(stream_json_lines(spark, path, **options)))
    seconds = F.coalesce(F.col("timestamp_ns") / 1e9, F.col("timestamp"))
    return canonical_logs(raw).withColumn("event_time", F.timestamp_seconds(seconds))


def alerts_to_files(scored: DataFrame, path: str, checkpoint: str, threshold: float = fv.ALERT_THRESHOLD) -> DataStreamWriter:
    """Alerts of a scored stream into parquet files, exactly once."""
    return (
        scored.filter(scoring.is_alert(threshold)).writeStream.outputMode("append")
        .format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    )


def triage_stream(
    scored: DataFrame,
    nodes: Callable[[], DataFrame],
    edges: Callable[[], DataFrame],
    connect: Callable[[], prompts.Client],
    path: str,
    checkpoint: str,
    **options,
) -> DataStreamWriter:
    """Tier 2 per micro-batch: report each batch's alerted processes.

    ``nodes`` and ``edges`` are read anew per batch, so the graph may grow
    meanwhile. Each batch owns one output folder: a retried batch replaces it. What
    a batch stores on the way is deleted after its output is written.
    """
    def enrich(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            done = triage(batch, nodes(), edges(), connect, **options)
            done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return scored.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint)


def running_confusion(scored: DataFrame, threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """Running confusion counts of the threshold against the labels.

    Write with output mode ``complete``. The state is one row.
    """
    graded = scored.withColumn(
        "outcome", evaluate.outcome(scoring.is_alert(threshold), F.col("is_evil"))
    )
    return evaluate.confusion(graded)


def upsert_graph(
    logs: DataFrame, path: str, checkpoint: str, order: Sequence[str] | None = None
) -> DataStreamWriter:
    """Add each micro-batch to a growing graph.

    A batch is reduced to its links and typed edges, and these are merged into the stores level by level
    (``MergeStore``): its cost is that of the batch and of the buckets it fills, and a retry changes nothing.
    "Last" is by arrival, or by ``order`` where the logs carry their own order.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        if order is None:
            arrived = batch.withColumn("src_batch", F.lit(batch_id).cast("long")).withColumn(
                "src_row", F.monotonically_increasing_id()
            )
            add_to_graph(arrived, path, batch_id, ("src_batch", *INPUT_ORDER))
        else:
            add_to_graph(batch, path, batch_id, order)

    return logs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def link_store(spark: SparkSession, path: str, **options) -> MergeStore:
    """The links of a growing graph, one per (src, dst): the last command by input position wins."""
    return MergeStore(spark, path, ["src", "dst"], graph.merge_links, **options)


def typed_edge_store(spark: SparkSession, path: str, **options) -> MergeStore:
    """The distinct typed edges of a growing graph, beside its links."""
    keys = ["rel", "src", "dst", "port", "timestamp", "type"]
    return MergeStore(spark, f"{path.rstrip('/')}-typed", keys, lambda rows: rows.distinct(), **options)


def add_links(
    logs: DataFrame, path: str, batch_id: int, order: Sequence[str] = INPUT_ORDER, numbered: bool = False, **options
) -> None:
    """Merge one load's links in, for a graph whose typed edges nobody reads; the same load twice changes nothing.

    ``numbered``: number its new nodes too, as ``number_nodes`` does, from the same links.
    """
    spark, links = logs.sparkSession, graph.spawn_links(logs, order)
    numbers = node_numbers(spark, path, **options)
    if numbered and batch_id not in numbers.store.loads():
        links = materialize(links, "load-links")
    link_store(spark, path, **options).add(links, batch_id, merged=True)
    if numbered:
        numbers.add(graph.nodes_of(links), batch_id)


def add_to_graph(logs: DataFrame, path: str, batch_id: int, order: Sequence[str] = INPUT_ORDER, **options) -> None:
    """Merge one load's links and typed edges in; the same load twice changes nothing."""
    add_links(logs, path, batch_id, order, **options)
    typed_edge_store(logs.sparkSession, path, **options).add(graph.typed_edges(logs), batch_id, merged=True)


def node_numbers(spark: SparkSession, path: str, **options) -> IdNumbers:
    """The stable numbers of a growing graph's nodes, beside its links."""
    return IdNumbers(spark, f"{path.rstrip('/')}-numbers", **options)


def number_nodes(logs: DataFrame, path: str, batch_id: int, order: Sequence[str] = INPUT_ORDER, **options) -> None:
    """Number the nodes that one load brings anew; nodes of earlier loads keep theirs."""
    nodes = graph.nodes_of(graph.spawn_links(logs, order))
    node_numbers(logs.sparkSession, path, **options).add(nodes, batch_id)


def read_grown_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, idx, seed) of all nodes and their edges by number, under numbers that later loads do not change."""
    nodes, edges = read_grown_graph(spark, path)
    numbers = node_numbers(spark, path).read()
    index = nodes.join(numbers, "id").select("id", "idx", feature_seed(F.col("cmd_line")).alias("seed"))
    return index, features.edge_index(edges, numbers)


def read_grown_typed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Distinct typed edges over all loads so far; file and network nodes come from them."""
    return typed_edge_store(spark, path).read()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of all loads so far."""
    return link_store(spark, path).read()


def read_grown_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over all loads so far."""
    links = read_links(spark, path)
    return graph.nodes_of(links), graph.edges_of(links)


def compact_graph(spark: SparkSession, path: str, new_path: str, buckets: int | None = None) -> None:
    """Copy a growing graph with one run per bucket; later loads go on there."""
    link_store(spark, path).copy_to(new_path, buckets)
    typed_edge_store(spark, path).copy_to(f"{new_path.rstrip('/')}-typed", buckets)
