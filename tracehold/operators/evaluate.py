"""Sampling, verdict grading and metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.hashing import sample_key
from tracehold.functions.numeric import ratio
from tracehold.session import materialize

Result = TypeVar("Result")


def label_name(label: Column) -> Column:
    return F.when(label == 1, F.lit(fv.LABEL_NAMES[1])).otherwise(F.lit(fv.LABEL_NAMES[0]))


def says_malicious(text: Column) -> Column:
    """True where the text says malicious and nowhere benign, in any case."""
    low = F.lower(text)
    return low.contains(fv.MALICIOUS_WORD) & ~low.contains(fv.BENIGN_WORD)


def outcome(predicted: Column, is_evil: Column) -> Column:
    """TP / FP / TN / FN; NULL where there is no prediction."""
    hit = is_evil == 1
    return (
        F.when(predicted & hit, "TP").when(predicted, "FP")
        .when(~predicted & hit, "FN").when(~predicted, "TN")
    )


def grade(rows: DataFrame, text: str = "text", label: str = "is_evil", error: str = "error") -> DataFrame:
    """Add ``predicted`` and ``outcome``; failed calls stay in the rows, ungraded."""
    predicted = F.when(F.col(error).isNull(), says_malicious(F.col(text)))
    return rows.withColumn("predicted", predicted).withColumn(
        "outcome", outcome(F.col("predicted"), F.col(label))
    )


def class_counts(logs: DataFrame, label: str = "is_evil") -> DataFrame:
    """Rows per class; every label but 1 counts as benign."""
    return logs.groupBy(label_name(F.col(label)).alias("class")).agg(F.count("*").alias("n_logs"))


def confusion(graded: DataFrame, by: Sequence[str] = (), seconds: str | None = None) -> DataFrame:
    """tp, fp, tn, fn and n (all rows, ungraded ones included), per group if asked."""
    counts = [
        F.count_if(F.col("outcome") == name).alias(name.lower()) for name in ("TP", "FP", "TN", "FN")
    ]
    extra = [F.sum(seconds).alias("seconds")] if seconds else []
    return graded.groupBy(*by).agg(*counts, F.count("*").alias("n"), *extra)


def metrics(counts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Add accuracy, precision, recall and f1 (0.0 where undefined), times ``scale``.

    Accuracy is over all rows, so a failed call counts against it.
    """
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    shares = counts.withColumns({
        "accuracy": ratio(tp + tn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    })
    pr, re = F.col("precision"), F.col("recall")
    shares = shares.withColumn("f1", ratio(2 * (pr * re), pr + re))
    return shares.withColumns(
        {c: F.col(c) * F.lit(scale) for c in ("accuracy", "precision", "recall", "f1")}
    )


def for_each_model(logs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every log once per model. The model list is short, so this is one generator."""
    return logs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def balanced_sample(
    logs: DataFrame,
    key: Sequence[str],
    n: int = fv.SAMPLE_PER_CLASS,
    seed: int = 0,
    label: str = "is_evil",
) -> DataFrame:
    """min(n, class size) rows per class without replacement, by hashed key.

    The logs are read once. A task passes on a row only if fewer than n rows of its class that it has seen
    lie in lower hash ranges; the rows of all tasks that may be among the lowest n are stored. Of these, the hash
    ranges (65,536) that lie below the n-th row are taken whole, and only the one that it falls into is
    ranked. No class ever meets in one task, and a task holds counts only, whatever n is.
    """
    columns = [F.col(c) for c in key]
    hashed = logs.withColumn("_class", F.when(F.col(label) == 1, 1).otherwise(0)).withColumn(
        "_key", sample_key(seed, *columns)
    ).withColumn("_range", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
    ranges = materialize(_low_rows(hashed, n), "sample-candidates")
    counts = ranges.groupBy("_class", "_range").agg(F.count("*").alias("_n")).collect()  # 2 x 65,536 at most
    whole, split, left = F.lit(False), F.lit(False), F.lit(0)
    for kind in (0, 1):
        at, before = 1 << 16, 0
        for row in sorted((r for r in counts if r["_class"] == kind), key=lambda r: r["_range"]):
            if before + row["_n"] > n:
                at = row["_range"]
                break
            before += row["_n"]
        whole = whole | ((F.col("_class") == kind) & (F.col("_range") < at))
        split = split | ((F.col("_class") == kind) & (F.col("_range") == at))
        left = F.when(F.col("_class") == kind, n - before).otherwise(left)
    place = F.row_number().over(Window.partitionBy("_class").orderBy("_key", *columns))
    ranked = ranges.filter(split).withColumn("_rank", place).filter(F.col("_rank") <= left)
    return ranges.filter(whole).unionByName(ranked.drop("_rank")).select(*logs.columns)


def _low_rows(hashed: DataFrame, n: int) -> DataFrame:
    """The rows that may be among the n of their ``_class`` with the lowest ``_range`` (16 bits), task by task.

    Only these two columns go to Python.
    """
    @F.pandas_udf("boolean")
    def may_be_taken(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen = np.zeros((2, 1 << 16), dtype=np.int64)
        limit = [1 << 16, 1 << 16]  # the range in which the n-th row is so far
        for kinds, ranges in batches:
            kinds, ranges = kinds.to_numpy(), ranges.to_numpy()
            keep = np.zeros(len(ranges), dtype=bool)
            for kind in (0, 1):
                mine = (kinds == kind) & (ranges <= limit[kind])
                seen[kind] += np.bincount(ranges[mine], minlength=1 << 16)
                total = np.cumsum(seen[kind])
                limit[kind] = int(np.searchsorted(total, n)) if total[-1] >= n else 1 << 16
                keep |= mine & (ranges <= limit[kind])
            yield pd.Series(keep)

    kept = may_be_taken.asNondeterministic()("_class", "_range")  # hangs on the rows before, so it is asked once per row
    return hashed.withColumn("_kept", kept).filter("_kept").drop("_kept")


def shuffled(sample: DataFrame, key: Sequence[str], seed: int = 1) -> DataFrame:
    """The (small) sample in reproducible random order."""
    columns = [F.col(c) for c in key]
    return sample.orderBy(sample_key(seed, *columns), *columns)


def timed(action: Callable[[], Result]) -> tuple[Result, float]:
    """An action's result and its seconds, rounded to 2 places."""
    start = time.monotonic()
    result = action()
    return result, round(time.monotonic() - start, 2)
