"""End-to-end jobs: logs to graph, graph to model, tiered triage, model comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.operators import ancestry, evaluate, features, graph, prompts, reports, scoring
from tracehold.operators.figures import Figures
from tracehold.operators.normalize import canonical_logs, process_key
from tracehold.operators.skew import lookup
from tracehold.operators.training import fit
from tracehold.session import materialize, new_folder
from tracehold.sinks.logs import write_alerts, write_logs
from tracehold.sources import archives, graph_store
from tracehold.sources.json_logs import (
    INPUT_ORDER, accepted, file_errors, good_records, parse_json, read_json_files, read_json_lines, read_json_objects, read_logs,
)
from tracehold.sources.labelled_csv import read_labelled_splits


def load_logs(spark: SparkSession, path, layout: str = "files") -> DataFrame:
    """Canonical logs of one path or several."""
    return canonical_logs(read_logs(spark, path, layout))


def extract_archives(
    spark: SparkSession,
    path,
    out: str,
    decode: Callable[[BinaryIO], Iterator[str]] = archives.decode_avro_gzip,
) -> tuple[DataFrame, DataFrame]:
    """Event archives to JSON-lines logs, one folder per split.

    Files that belong to no split are left out. Returns (rows per split and file,
    files that failed); a failed file adds no rows. Decoding is the costly step
    and cannot be split within a file, so its output is stored once.
    """
    decoded = materialize(archives.read_archives(spark, path, decode), "decoded")
    records = good_records(decoded, whole_files_only=True)
    logs = archives.extract_logs(archives.parse_events(records)).filter(F.col("split").isNotNull())
    write_logs(logs, out)
    return archives.split_counts(logs), file_errors(decoded)


def convert_labelled_csv(spark: SparkSession, folder: str, out: str, files: Mapping | None = None) -> DataFrame:
    """Labelled CSV files to JSON-lines logs, one folder per split; returns row counts."""
    logs = read_labelled_splits(spark, folder, files)
    write_logs(logs, out)
    return archives.split_counts(logs)


def build_graph(logs: DataFrame, path: str, order: Sequence[str] = INPUT_ORDER) -> tuple[DataFrame, DataFrame]:
    """Rebuild the stored process graph from logs; returns (nodes, edges).

    The logs are read once: links are stored first, nodes and edges come from them.
    """
    spark = logs.sparkSession
    links = materialize(graph.spawn_links(logs, order), "links")
    graph_store.write_graph(graph.nodes_of(links), graph.edges_of(links), path)
    return graph_store.read_nodes(spark, path), graph_store.read_edges(spark, path)


def build_property_graph(logs: DataFrame, path: str, order: Sequence[str] = INPUT_ORDER) -> dict[str, DataFrame]:
    """Rebuild and store the whole graph: process_nodes, spawn_edges, typed_edges, file_nodes, network_nodes.

    The logs are read once for processes and once for typed edges; file and network nodes come
    from the stored edges.
    """
    spark = logs.sparkSession
    nodes, edges = build_graph(logs, path, order)
    graph_store.write_typed_edges(graph.typed_edges(logs), f"{path}/typed_edges")
    typed = graph_store.read_typed_edges(spark, f"{path}/typed_edges")
    return {
        "process_nodes": nodes,
        "spawn_edges": edges,
        "typed_edges": typed,
        "file_nodes": materialize(graph.files_of(typed), "files", f"{path}/file_nodes"),
        "network_nodes": materialize(graph.networks_of(typed), "networks", f"{path}/network_nodes"),
    }


def train(nodes: DataFrame, edges: DataFrame, weights_path: str | None = None, **options):
    """Index the graph and fit the autoencoder; returns (weights, losses)."""
    path = new_folder(nodes.sparkSession, "graph-index")
    index, pairs = index_graph(nodes, edges, path)
    return fit(index, pairs, weights_path=weights_path, **options)


def index_graph(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Store the model's view of a graph: (id, idx, seed) nodes and numbered edges."""
    spark = nodes.sparkSession
    index = materialize(features.node_index(nodes), "node-index")
    graph_store.write_graph(index, features.edge_index(edges, index), path)
    return graph_store.read_nodes(spark, path), graph_store.read_edges(spark, path)


def score_files(
    spark: SparkSession,
    path,
    out: str,
    score: Callable[[DataFrame], DataFrame],
    layout: str = "files",
    threshold: float = fv.ALERT_THRESHOLD,
) -> DataFrame:
    """Score the logs of files and write the alerts to ``out``; returns (stage, measure, value) figures of the run.

    One pass: records, unreadable files, rejected records, logs and alerts are counted as they go by. A file
    that is not read whole gives its good part and an error.
    """
    figures = Figures(spark)
    if layout == "files":
        decoded = figures.watch(read_json_files(spark, path), "read", records=F.count("record"), errors=F.count("error"))
        records = good_records(decoded)
    else:
        reader = {"lines": read_json_lines, "objects": read_json_objects}[layout]
        records = figures.watch(reader(spark, path), "read", records=F.count("record"))
    parsed = figures.watch(parse_json(records), "parse", rejected=F.count("rejected"))
    logs = figures.watch(
        canonical_logs(accepted(parsed)), "logs", logs=F.count("*"),
        malicious=F.count_if(F.col("is_evil") == 1), benign=F.count_if(~F.col("is_evil").eqNullSafe(1)))
    alerts = figures.watch(score(logs).filter(scoring.is_alert(threshold)), "score", alerts=F.count("*"))
    with figures.timed("run"):
        write_alerts(alerts, out, "overwrite")
    return figures.table()


def triage(
    scored: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    connect: Callable[[], prompts.Client],
    threshold: float = fv.ALERT_THRESHOLD,
    **options,
) -> DataFrame:
    """Alerts with their incident report. Costly stages see alerted processes only.

    Alerts are stored first: the model-call stages must not make the scoring run
    again.
    """
    alerts = materialize(
        scored.filter(scoring.is_alert(threshold)).withColumn(
            "process_id", process_key(use_thread=False)
        ),
        "alerts",
    )
    contexts = alert_contexts(alerts, nodes, edges)
    done = reports.incident_reports(contexts, connect, **options)
    wanted = done.select(
        F.col("process_id").alias("_id"), "report", "unsafe", "error",
        F.col("seconds").alias("report_seconds"),
    )
    return lookup(alerts, "process_id", wanted, "_id").drop("_id")


def alert_contexts(alerts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One (process_id, context) row per alerted process, in the short form."""
    ids = alerts.select(F.col("process_id").alias("id")).distinct()
    found = ancestry.short_contexts(nodes, edges, ids)
    return ids.join(found, "id", "left").select(
        F.col("id").alias("process_id"),
        F.coalesce("context", F.lit(fv.NO_SHORT_CONTEXT)).alias("context"),
    )


def triage_metrics(scored: DataFrame, threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """Confusion counts and metrics of the threshold against the labels, one row."""
    graded = scored.withColumn(
        "outcome", evaluate.outcome(scoring.is_alert(threshold), F.col("is_evil"))
    )
    return evaluate.metrics(evaluate.confusion(graded))


def evaluate_model(
    logs: DataFrame,
    contexts: DataFrame,
    connect: Callable[[], prompts.Client],
    key: str,
    log: Column,
    n: int = fv.SAMPLE_PER_CLASS,
    seed: int = 0,
    **options,
) -> DataFrame:
    """Metrics of one model over a class-balanced sample of the logs."""
    sample = materialize(evaluate.balanced_sample(logs, [key], n, seed), "sample")
    return compare_models(sample, contexts, {"model": connect}, key, log, **options).drop("model")


def compare_models(
    sample: DataFrame,
    contexts: DataFrame,
    clients: Mapping[str, Callable[[], prompts.Client]],
    key: str,
    log: Column,
    template: prompts.Template = prompts.VERDICT,
    **options,
) -> DataFrame:
    """Metrics per model (percentages) over one sample of logs.

    The context of a process is looked up once and reused by every model. The
    loop is over the handful of models; each one's calls are a Spark job.
    """
    rows = ancestry.attach_context(
        sample.withColumn("process_id", process_key(use_thread=False)).withColumn("_log", log),
        contexts, fv.NO_LONG_CONTEXT,
    )
    rows = materialize(rows, "comparison-sample")
    answered = [
        reports.verdicts_of(rows, key, F.col("_log"), connect, template, **options)
        .withColumn("model", F.lit(model))
        for model, connect in clients.items()
    ]
    graded = evaluate.grade(graph_store.union_sources(answered), text="analysis")
    return evaluate.metrics(evaluate.confusion(graded, by=["model"], seconds="seconds"), 100.0)
