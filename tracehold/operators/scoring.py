"""Per-log anomaly score, context boost and alerts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.hashing import broadcast_vectors, seeds_of_digests, text_digest
from tracehold.functions.text import contains_any, once, two_decimals
from tracehold.operators.features import fingerprint, parent_text, shown_command
from tracehold.operators.normalize import log_command, process_key
from tracehold.sources.json_logs import INPUT_ORDER


def pair_scores(parent: np.ndarray, child: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Anomaly of parent -> child pairs, a whole batch of feature rows at once.

    The two-node graph has in-degrees 1 and 2 with self-loops, so the model's
    two propagation rounds have constant coefficients 1, 1/2 and 1/sqrt(2).
    """
    r = 1.0 / np.sqrt(2.0)
    w1, b1, w2, b2 = (weights[n] for n in ("W1", "b1", "W2", "b2"))
    p, c = parent @ w1, child @ w1
    hidden_parent = np.maximum(p + b1, 0.0) @ w2
    hidden_child = np.maximum(c / 2 + p * r + b1, 0.0) @ w2
    z_parent = hidden_parent + b2
    z_child = hidden_child / 2 + hidden_parent * r + b2
    logit = (z_parent * z_child).sum(axis=1)
    return 1.0 / (1.0 + np.exp(np.clip(logit, -700.0, 700.0)))


def base_score(spark: SparkSession, weights: dict[str, np.ndarray]):
    """Vectorised column function (parent_digest, child_digest) -> anomaly in [0, 1].

    Row-local: two 32-byte digests in, one number out; no join and no shuffle. The
    feature dictionary is a fixed 6.4 MB broadcast. Digests come from the JVM; their
    remainder is taken here, where a batch of them costs eight array operations.
    """
    table = broadcast_vectors(spark)
    fixed = {name: np.asarray(value, dtype=np.float64) for name, value in weights.items()}

    @F.pandas_udf("double")
    def score(parent_digest: pd.Series, child_digest: pd.Series) -> pd.Series:
        vectors = table.value
        return pd.Series(pair_scores(
            vectors[seeds_of_digests(parent_digest)].astype(np.float64),
            vectors[seeds_of_digests(child_digest)].astype(np.float64),
            fixed,
        ))

    return score


def is_risky(words: Sequence[str] = fv.RISK_WORDS, whole_words: bool = False) -> Column:
    """True where the command or the process name holds a risk word."""
    return contains_any(log_command(), words, whole_words) | contains_any(
        F.col("process_name"), words, whole_words
    )


def boosted(score: Column, risky: Column) -> Column:
    """Raise the score of risky logs past the threshold; cap all scores."""
    return F.least(
        F.lit(fv.SCORE_CAP), F.when(risky, score + F.lit(fv.RISK_BOOST)).otherwise(score)
    )


def with_score(logs: DataFrame, base: Column, whole_words: bool = False) -> DataFrame:
    """Add ``score`` from a base-score column."""
    score = boosted(base, is_risky(whole_words=whole_words))
    return logs.select("*", once(score).alias("score"))


def score_logs(logs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """Add ``score`` from the trained model. Works on batch and streaming frames."""
    model = base_score(logs.sparkSession, weights)
    digests = [F.unhex(text_digest(text)) for text in (parent_text(), fingerprint())]
    return with_score(logs.withColumn("base_score", model(*digests)), F.col("base_score"))


def is_alert(threshold: float = fv.ALERT_THRESHOLD) -> Column:
    return F.col("score") > F.lit(threshold)


def first_logs(logs: DataFrame, n: int = fv.FIRST_LOGS, order: Sequence[str] = INPUT_ORDER) -> DataFrame:
    """The first n logs in input order (a top-n plan, not a full sort)."""
    return logs.orderBy(*order).limit(n)


def alert_lines(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Process id, shown command and score text of each log."""
    return scored.select(
        *keep,
        process_key(use_thread=False).alias("process_id"),
        shown_command().alias("shown_cmd"),
        two_decimals(F.col("score")).alias("score_text"),
    )
