"""Numbers of ids that stay the same while a graph grows.

An append-only dictionary of (id, idx): the ids that a load brings anew are range-sorted and numbered after all earlier
ones, and written as runs of a keyed store. Nothing is renumbered, so whatever is kept by number
(embeddings, indexed edges) stays valid for the nodes that a load does not touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehold.operators.features import dense_index
from tracehold.session import materialize
from tracehold.sources.merge_store import MergeStore


class IdNumbers:
    """The numbers 0 .. n-1 of all ids of all loads so far. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, **options) -> None:
        """``options`` (``buckets``, ``fanout``) are those of ``MergeStore``."""
        self.spark = spark
        # an id is in one run only, so runs are put together as they are
        self.store = MergeStore(spark, path, ["id"], lambda rows: rows, **options)

    def add(self, ids: DataFrame, load: int) -> bool:
        """Number the ids (column ``id``) that are new, in id order; False if that load was added before.

        Null ids and repeats have no number of their own. The ids of the load are looked up in the dictionary, which
        is not moved where the load is small. A load that fails leaves no trace.
        """
        if load in self.store.loads():
            return False
        wanted = materialize(ids.select("id").filter(F.col("id").isNotNull()).distinct(), "load-ids")
        start = 0
        if self.store.loads():
            known = self.store.read()
            start = known.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
            held = materialize(known.join(wanted, "id").select("id"), "known-ids")
            wanted = wanted.join(held, "id", "left_anti")
        numbered = dense_index(wanted, ["id"]).withColumn("idx", F.col("idx") + F.lit(start).cast("long"))
        return self.store.add(numbered.select("id", "idx"), load, merged=True)

    def read(self) -> DataFrame:
        """(id, idx) of all loads so far."""
        return self.store.read()
