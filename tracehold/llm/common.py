"""Helpers shared by the operators: table reading, stored steps and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracehold.session import delete_folder, materialize, new_folder

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes between words: ASCII white space, or all of ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A frame written to the shared folder and read back, and its path."""
    path = new_folder(frame.sparkSession, label)
    return materialize(frame, label, path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete stored steps that nothing reads any more."""
    for path in paths:
        delete_folder(spark, path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(*arrays: np.ndarray) -> np.ndarray:
    """The different numbers of some arrays in ascending order.

    One copy is sorted in place. From version 2.3 on ``np.unique`` fills a hash set instead, which takes several
    times the memory of the numbers (and of the time), and leaves the process's memory in small pieces.
    """
    numbers = np.concatenate(arrays)
    numbers.sort()
    if len(numbers):
        first = np.empty(len(numbers), dtype=bool)
        first[0] = True
        np.not_equal(numbers[1:], numbers[:-1], out=first[1:])
        numbers = numbers[first]
    return numbers


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, and where each row begins (one more at the end).

    Nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges of at most so many bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, stem: int = 0):
    """64-bit hashes of some spans of bytes, A-Z as a-z; with ``stem`` also of so many first bytes of each."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * powers(_B, n), out=sums[1:])
    back = powers(_B_INVERSE, n)[first]
    hashes = mix((sums[last] - sums[first]) * back)
    return (hashes, mix((sums[np.minimum(first + stem, last)] - sums[first]) * back)) if stem else hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE, stem: int = 0):
    """64-bit hashes of the words of some rows, and the first word of each row (one more at the end).

    Words are runs without the bytes ``between``; A-Z count as a-z. ``offsets`` are
    relative to ``data`` and start at 0. With ``stem``, also hashes of the words' first bytes, so many.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.uint64)
        return (empty, np.zeros(len(offsets), np.int64), *([empty] if stem else []))
    word = ~between[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hashes(data, first, last, stem)
    return (hashes[0], np.searchsorted(first, offsets), hashes[1]) if stem else (hashes, np.searchsorted(first, offsets))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; k less than the number of words shorter."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j:j + n]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """Distinct k-word shingles of each row, sorted; with fewer words the whole sequence is one.

    Yields one array per row; a row without words has an empty one.
    """
    words, first = word_hashes(data, offsets)
    runs = sequence_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a:b - k + 1])
        elif b > a:
            whole = sequence_hashes(words[a:b], b - a)
            yield mix(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def slices(column: pa.Array, limit: int = STEP_BYTES):
    """(first row, end row, bytes, offsets from 0) of a column of strings, step by step."""
    data, offsets = text_bytes(column)
    for i, j in steps(offsets, limit):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
