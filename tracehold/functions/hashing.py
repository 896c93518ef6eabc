"""Deterministic hashing of texts to feature seeds, and seeds to vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehold.functions import fixed_values as fv
from tracehold.functions.text import or_default


def hex_mod(hex64: Column, modulus: int) -> Column:
    """A 64-digit hex number modulo a small integer, without big integers.

    The number is cut into pieces of at most 13 hex digits, which fit a long; each
    piece modulo ``modulus`` times its place value modulo ``modulus`` stays small.
    """
    if modulus > 2**30:
        raise ValueError("modulus too large for 64-bit sums")
    total = None
    for start in range(0, 64, 13):
        end = min(start + 13, 64)
        piece = F.conv(F.substring(hex64, start + 1, end - start), 16, 10).cast("long")
        term = (piece % F.lit(modulus)) * F.lit(pow(16, 64 - end, modulus))
        total = term if total is None else total + term
    return total % F.lit(modulus)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text as hex; NULL and empty count as 'unknown'."""
    return F.sha2(or_default(text, fv.UNKNOWN_TEXT), 256)


def feature_seed(text: Column) -> Column:
    """Seed of a text's feature vector."""
    return hex_mod(text_digest(text), fv.SEED_COUNT)


def seeds_of_digests(digests: pd.Series) -> np.ndarray:
    """Seeds of 32-byte digests, a whole batch at once (for use inside tasks)."""
    words = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 8).astype(np.uint64)
    seeds = np.zeros(len(words), dtype=np.uint64)
    for word in words.T:
        seeds = ((seeds << np.uint64(32)) + word) % np.uint64(fv.SEED_COUNT)
    return seeds.astype(np.int64)


def draw(label: str, row: Column, modulus: Column) -> Column:
    """Reproducible uniform draw in [0, modulus) from a label and a row number."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(label), row.cast("string")), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long") % modulus


def sample_key(seed: int, *columns: Column) -> Column:
    """Reproducible random sort key of a row."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]), 256)


def vectors_for(seeds: np.ndarray, width: int = fv.FEATURE_WIDTH) -> np.ndarray:
    """One row of uniform float32 draws per seed (Mersenne Twister, 24-bit draws)."""
    rows = np.empty((len(seeds), width), dtype=np.float32)
    generator = np.random.RandomState()
    for i, seed in enumerate(seeds):
        generator.seed(int(seed))
        words = generator.randint(0, 2**32, width, dtype=np.uint32)
        rows[i] = (words & 0xFFFFFF) / np.float64(2**24)
    return rows


def seed_vectors(spark: SparkSession, width: int = fv.FEATURE_WIDTH) -> DataFrame:
    """The dictionary of all feature vectors: (seed, x0..x{width-1}).

    Its size is fixed by the seed count (100,000 rows, 6.4 MB), whatever the data.
    """
    names = [f"x{i}" for i in range(width)]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(vectors_for(batch["id"].to_numpy(), width), columns=names)
            out.insert(0, "seed", batch["id"].to_numpy())
            yield out

    schema = "seed long, " + ", ".join(f"{n} float" for n in names)
    return spark.range(fv.SEED_COUNT).mapInPandas(fill, schema)


_tables: dict[str, object] = {}


def broadcast_vectors(spark: SparkSession):
    """The dictionary as a broadcast float32 matrix (fixed 6.4 MB), built by Spark once."""
    context = spark.sparkContext
    key = context.applicationId
    if key not in _tables:
        rows = seed_vectors(spark).toPandas().sort_values("seed")
        _tables[key] = context.broadcast(rows.drop(columns="seed").to_numpy(np.float32))
    return _tables[key]
