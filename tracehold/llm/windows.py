"""Substring dedup: Rabin-Karp hashes of all windows of k words, counted in Spark.

Texts with the same words count once. Every window of the others is hashed in 96 bits, rolled along the
word hashes. A window is named by the smallest hash of the half-window grams in it; equal windows
have equal names, so that a window whose name occurs in one text only cannot be repeated and need not
be counted. This leaves out no repeated window. The other windows are counted by their hashes;
those that start in a document with a smaller doc_id merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import SPACE, drop_stored, mix, powers, slices, stored

_BYTE = 0x9E3779B97F4A7C15
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SALT = np.uint64(0xE7037ED1A0B428DB)


def _rolled(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of the k values from each place on."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the words of some texts, and each text's first word (one more at the end)."""
    n = len(data)
    word = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    ends[:-1] &= ~word[1:] | cut[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def _word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, unchanged."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BYTE, n), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(pow(_BYTE, -1, 1 << 64), n + 1)[first])


def _smallest(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of the w values from each place on, by doubling."""
    have, width, out, at = values, 1, None, 0
    while True:
        if w & width:  # a block of this width stands next
            part = have[at:]
            out = part if out is None else np.minimum(out[:len(part)], part)
            at += width
        width *= 2
        if width > w:
            return out[:max(0, len(values) - w + 1)]
        have = np.minimum(have[:-(width // 2)], have[width // 2:]) if len(have) > width // 2 else have[:0]


def _names(words: np.ndarray, k: int) -> np.ndarray:
    """The name of every window of k words: the smallest hash of its grams of half as many words."""
    gram = max(1, k // 2)
    return _smallest(_rolled(words, gram, _BASES[0]), k - gram + 1) if len(words) >= k else np.zeros(0, np.uint64)


def _described(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n_words, the SHA-256 of the words joined by a space, and the names of the windows, of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                whole, edges = data.tobytes(), offsets.tolist()
                keys = [hashlib.sha256(b" ".join(whole[a:b].split())).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                first, last, at = word_spans(data, offsets)
                names = _names(_word_hashes(data, first, last), k)
                lists = [np.unique(names[a:b - k + 1]) if b - a >= k else names[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sizes = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i:j], pa.array(keys, type=pa.binary()), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*lists, names[:0]]).view(np.int64))),
                ], ["doc_id", "key", "n_words", "names"])

    return rows.mapInArrow(work, "doc_id long, key binary, n_words long, names array<long>")


def _windows(candidates: DataFrame, k: int) -> DataFrame:
    """doc_id, row, place and the two hashes of every window that bears a shared name."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, shared = batch.column(0), batch.column(1), batch.column(3)
            for i, j, data, offsets in slices(batch.column(2)):
                first, last, at = word_spans(data, offsets)
                words = _word_hashes(data, first, last)
                names = _names(words, k)
                keep = np.zeros(len(names), dtype=bool)
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if b - a >= k:
                        keep[a:b - k + 1] = np.isin(names[a:b - k + 1], np.asarray(shared[i + row].values).view(np.uint64))
                place = np.flatnonzero(keep)
                owner = np.searchsorted(at, place, side="right") - 1
                one = _rolled(words, k, _BASES[0])[place]
                two = _rolled(mix(words ^ _SALT), k, _BASES[1])[place] >> np.uint64(32)
                take = pa.array(i + owner)
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), rows.take(take), pa.array((place - at[owner]).astype(np.int32)),
                    pa.array(one.view(np.int64)), pa.array(two.astype(np.uint32).view(np.int32)),
                ], ["doc_id", "row", "place", "h1", "h2"])

    return candidates.select("doc_id", "row", "text", "shared").mapInArrow(work, "doc_id long, row long, place int, h1 long, h2 int")


def intervals(places: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal runs of words (begin, end exclusive) that the windows from some places on cover."""
    places = np.sort(places)
    if not len(places):
        return []
    apart = np.flatnonzero(np.diff(places) > k)
    return list(zip(places[np.append(0, apart + 1)].tolist(), (places[np.append(apart, len(places) - 1)] + k).tolist(), strict=True))


def _texts(rows: DataFrame, k: int, repeats: bool = False) -> DataFrame:
    """doc_id, key and text of the rows of k words or more; without ``repeats``, a task passes equal rows on once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, take = [], []
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = text.as_py().encode().split()
                key = hashlib.sha256(b" ".join(words)).digest()
                if len(words) < k or (doc_id, key) in seen:
                    continue
                if not repeats:
                    seen.add((doc_id, key))
                keys.append(key)
                take.append(row)
            taken = batch.take(pa.array(take, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(keys, type=pa.binary()), taken.column(1)], ["doc_id", "key", "text"])

    return rows.mapInArrow(work, "doc_id long, key binary, text string")


def _split(frame: DataFrame, *names: str) -> DataFrame:
    """One more join key than either side is grouped by: the join deals both sides itself and can split a hot key."""
    return frame.withColumn("_both", F.xxhash64(*names))


def removals(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, key, n_words, spans of removed words (begin, end) and the SHA-256 of the kept words of every row.

    Words stand between ASCII white space and are taken unchanged. A word goes if it lies in a window
    of ``window`` words whose words also start in a document with a smaller doc_id; windows are
    judged on the input. Spans are maximal and in order. ``kept`` is the digest (bytes) of the
    kept words joined by a space, ``key`` that of all words. Null and empty texts have no words. Rows without a doc_id keep all
    words and remove none elsewhere. Rows with one doc_id do not remove each other's words; equal rows
    have equal results. Other columns are not looked at; no rows give none.
    """
    spark, none = documents.sparkSession, F.array().cast("array<struct<begin:int,end:int>>")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    described, described_path = stored(_described(rows, window), "described-texts")
    several = described.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    firsts = several.groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    # the names of each text's first document, and those that more than one document bears
    named = _split(several.select("key", "doc_id", "names"), "key").join(
        _split(firsts, "key"), ["_both", "key", "doc_id"]).select("key", "doc_id", F.explode("names").alias("name"))
    named, named_path = stored(named, "window-names")
    shared = named.groupBy("name").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("name")
    lists = _split(named, "name").join(_split(shared, "name"), ["_both", "name"]).groupBy("key", "doc_id").agg(
        F.collect_set("name").alias("shared"))
    lists = lists.withColumn("row", F.monotonically_increasing_id())
    lists, lists_path = stored(lists, "shared-names")
    candidates = _texts(rows, window).join(lists, ["key", "doc_id"])
    candidates, candidates_path = stored(candidates.select("row", "doc_id", "key", "text", "shared"), "texts-with-shared-names")

    # count the windows that bear those names
    found = _windows(candidates, window)
    counted = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high")
    places = _split(found, "h1", "h2").join(_split(counted.drop("_high"), "h1", "h2"), ["_both", "h1", "h2"]).where(
        "doc_id > _low").groupBy("row").agg(F.collect_set("place").alias("places"))
    removed = _kept(candidates.select("row", "key", "text").join(places, "row"), window).dropDuplicates(["key"])
    removed, removed_path = stored(removed, "removed-words")

    texts = _split(firsts.withColumnRenamed("doc_id", "_first").join(removed, "key", "left"), "key")
    joined = _split(described.select("doc_id", "key", "n_words"), "key").join(texts, ["_both", "key"], "left")
    copy = F.col("doc_id") > F.col("_first")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    result = joined.select(
        "doc_id", "key", "n_words", F.when(copy, whole).when(F.col("doc_id").isNotNull(), F.coalesce("spans", none)).otherwise(none).alias("spans"),
        F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).when(F.col("doc_id").isNotNull(), F.coalesce("kept", "key")).otherwise(
            F.col("key")).alias("kept"))
    drop_stored(spark, named_path, lists_path, candidates_path)
    return result


def _kept(rows: DataFrame, k: int) -> DataFrame:
    """key, spans and the digest of the kept words of rows with text and places."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, kept = batch.column(0), [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                words, at, parts = text.as_py().encode().split(), 0, []
                spans = intervals(np.asarray(places.values), k)
                for a, b in spans:
                    parts += words[at:a]
                    at = b
                kept.append(hashlib.sha256(b" ".join(parts + words[at:])).digest())
                out.append([{"begin": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(out, type=pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                pa.array(kept, type=pa.binary())], ["key", "spans", "kept"])

    return rows.select("key", "text", "places").mapInArrow(work, "key binary, spans array<struct<begin:int,end:int>>, kept binary")


def kept_texts(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id and text of every row; where words are removed, the text is the kept words joined by a space."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = removed.where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    words, at, parts = text.encode().split(), 0, []
                    for span in spans:
                        parts += words[at:span["begin"]]
                        at = span["end"]
                    text = b" ".join(parts + words[at:]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return _split(_texts(rows, 0, repeats=True), "key").join(_split(spans, "key"), ["_both", "doc_id", "key"], "left").select(
        "doc_id", "text", "spans").mapInArrow(work, "doc_id long, text string")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 from ``removals``."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return removed.select("doc_id", "n_words", n.alias("n_removed"), F.lower(F.hex("kept")).alias("kept_sha256"))


#: The query in DuckDB: windows as joined words, and the smallest doc_id that each starts in.
ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50 AND doc_id IS NOT NULL
), windows AS (
  SELECT r, doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM starts
), marked AS (
  SELECT r, p, min(doc_id) OVER (PARTITION BY h) < doc_id AS repeated FROM windows
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM marked WHERE repeated
), lists AS (
  SELECT r, list(p) AS ps FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') WHEN len(ps) = len(w) THEN ''
    ELSE array_to_string(list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)))), ' ') END) AS kept_sha256
FROM docs LEFT JOIN lists USING (r)
"""
