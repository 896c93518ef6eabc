"""Graph, feature and weight tables: parquet in, parquet out."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehold.functions import fixed_values as fv

WEIGHT_SCHEMA = "name string, row int, values array<double>"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Rebuild the stored graph from scratch."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/edges")


def write_typed_edges(edges: DataFrame, path: str) -> None:
    """Typed edges in one folder per relation, so that a reader of one kind reads no other."""
    edges.write.mode("overwrite").partitionBy("rel").parquet(path)


def read_typed_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("rel", "src", "dst", "port", "timestamp", "type")


def weight_shapes(
    inputs: int = fv.FEATURE_WIDTH, hidden: int = fv.HIDDEN_WIDTH
) -> dict[str, tuple[int, ...]]:
    return {"W1": (inputs, hidden), "b1": (hidden,), "W2": (hidden, hidden // 2), "b2": (hidden // 2,)}


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Trained weights (1,072 numbers at the usual width) as a small table."""
    rows = [
        (name, i, [float(v) for v in row])
        for name, matrix in weights.items()
        for i, row in enumerate(np.atleast_2d(matrix))
    ]
    spark.createDataFrame(rows, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The stored weights, in the shapes they were written in (names with b are vectors)."""
    rows = spark.read.schema(WEIGHT_SCHEMA).parquet(path).orderBy("name", "row").collect()
    weights = {}
    for name in weight_shapes():
        matrix = np.array([r["values"] for r in rows if r["name"] == name])
        weights[name] = matrix[0] if name.startswith("b") else matrix
    return weights


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Several data sets as one; a column missing in one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def count_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges."""
    kinds = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(
        edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return kinds.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))
