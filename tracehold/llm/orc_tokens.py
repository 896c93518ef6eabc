"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehold.llm.common import stored
from tracehold.llm.tokens import closed, encoder, id_lists, tokenizer_file

SCHEMA = "doc_id long, part int, row long, ids array<int>"
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000


def write_tokens(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every whole text, append ``end_id``, and write ids in ascending doc_id order.

    File n holds the n-th range of doc_ids; in it, row numbers count from 0. Null texts are
    empty; repeated doc_ids stay, ordered by a digest of their text; rows without a doc_id come
    first. The range split uses that digest too, so that one doc_id (or none) of very many rows
    is spread over files. Other columns are not read.
    """
    spark = documents.sparkSession
    definition = tokenizer_file(spark, tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, row = encoder(definition.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, counts in tokens.encode_column(batch.column(1)):
                n = j - i
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n), pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(np.arange(row, row + n)), id_lists(*closed(ids, counts, end_id))],
                    ["doc_id", "part", "row", "ids"])
                row += n

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, SCHEMA)
    ids.write.mode("overwrite").options(**{
        "orc.compress": "ZSTD", "orc.stripe.size": str(STRIPE_BYTES),
        "orc.row.index.stride": str(INDEX_STRIDE), "orc.bloom.filter.columns": "doc_id",
    }).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, row and ids; filters on doc_id prune by stripe statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the files.

    ``start`` counts the ids of all documents before: sums within a file, plus those of the
    files before it.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            values = np.ascontiguousarray(np.asarray(lists.values), dtype="<i4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, type=pa.int64()),
            ], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    found, _ = stored(read_tokens(spark, path).mapInArrow(
        digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"), "token-index")
    files = found.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "part").select(
        "doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
