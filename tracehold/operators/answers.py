"""Model answers kept by content: a table from prompt digest to answer.

A prompt that was answered once is not sent again: not by another stage, micro-batch, run, or row with the same
text. Prompts are looked up by a keyed join, each new one is asked once, and the answers of a round are
kept before any row uses them. Failed calls are not kept, so that a later round asks again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.operators.prompts import Client, call_model
from tracehold.operators.skew import lookup
from tracehold.session import materialize
from tracehold.sources.merge_store import MergeStore

_SCHEMA = "digest string, response string, seconds double"


def _first_kept(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(F.struct("response", "seconds")).alias("_a")).select("digest", "_a.*")


class AnswerStore:
    """Answers under a path; ``model`` tells apart clients that answer the same prompt differently.

    One writer at a time, as for ``MergeStore``. A job that ends between its calls and the commit of their
    answers asks these again; nothing else is asked twice.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "") -> None:
        self.spark, self.model = spark, model
        self.store = MergeStore(spark, path, ["digest"], _first_kept)

    def digest(self, prompt: Column) -> Column:
        """SHA-256 of the model's name and all messages, each part behind its length."""
        part = F.transform(prompt, lambda m: F.concat(
            F.length(m["role"]).cast("string"), F.lit(":"), m["role"], F.length(m["content"]).cast("string"), F.lit(":"), m["content"]))
        return F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}"), F.array_join(part, "")), 256)

    def kept(self) -> DataFrame:
        """(digest, response, seconds) of all answers so far."""
        return self.store.read() if self.store.loads() else self.spark.createDataFrame([], _SCHEMA)

    def answer(self, requests: DataFrame, connect: Callable[[], Client], key: str, **options) -> DataFrame:
        """(key, response, error, seconds) for (key, messages) rows.

        Equal prompts are one call however many rows have them; seconds are those of the call, and 0 where the
        answer was kept before. Rows with null messages get none. ``options`` go to ``call_model``.
        """
        asked = materialize(requests.select(key, "messages", self.digest(F.col("messages")).alias("digest")), "asked")
        known = self.kept().select("digest", F.lit(True).alias("_known"))
        distinct = asked.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("messages").alias("messages"))  # equal ones
        fresh = distinct.join(known, "digest", "left").where(F.col("_known").isNull()).drop("_known")
        told = materialize(call_model(fresh, connect, "digest", **options), "new-answers")
        good = told.where(F.col("error").isNull()).select("digest", "response", "seconds")
        if good.limit(1).count():
            self.store.add(good, max(self.store.loads(), default=-1) + 1, merged=True)
        failed = told.where(F.col("error").isNotNull()).select("digest", "error", F.col("seconds").alias("_failed"))
        new = told.select(F.col("digest").alias("_new"), F.col("seconds").alias("_call"))
        all_ = self.kept().join(failed, "digest", "full").join(new, F.col("digest") == F.col("_new"), "left").select(
            F.col("digest").alias("_digest"), F.when(F.col("error").isNull(), F.col("response")).alias("response"), "error",
            F.coalesce("_call", F.lit(0.0)).alias("seconds"))
        return lookup(asked.select(key, "digest"), "digest", all_, "_digest").select(key, "response", "error", "seconds")
