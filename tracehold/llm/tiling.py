"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words. Hashes of a few words, rolled along a text,
find the items' seeds. Of the equal seeds of a text and an item only those are listed that begin a maximal match, where
the words before differ: a repetitive text has few of these, however many seeds are equal. The longest match whose
words are all free is marked again and again, as a tile; what is left of an overlapped match is
cut to its free part. Tiles may stand in any order, so an item is found in a reordered passage
too. A text is contaminated by an item if tiles cover enough of the item's words.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tracehold.llm.common import MARKS, sequence_hashes, slices, word_hashes

#: Words of the shortest tile. Items with fewer words are no passages and are not searched.
TILE = 4
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of items that are searched, and broadcast, at once.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


class Items(NamedTuple):
    """Some benchmark items and an index of their seeds."""

    ids: np.ndarray
    words: np.ndarray  # of all items, one after another
    first: np.ndarray  # first word of each item, one more at the end
    seeds: np.ndarray  # hashes of TILE words, sorted by them, then by the word before (an item's first seed has none)
    item: np.ndarray  # of each seed
    place: np.ndarray  # of each seed in its item
    before: np.ndarray  # the word before each seed; any, where place is 0


def tiles(item: np.ndarray, text: np.ndarray, at_item: np.ndarray, at_text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length), longest first, from pairs of equal seeds.

    Ties go to the smaller place in the item, then in the text.
    """
    order = np.lexsort((at_item, at_text - at_item))
    a, b = at_item[order], at_text[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(a))) + least - 1
    return marked(len(item), len(text), a[heads], b[heads], lengths, least)


def marked(
    item_words: int, text_words: int, at_item: np.ndarray, at_text: np.ndarray, lengths: np.ndarray, least: int = TILE
) -> list[tuple[int, int, int]]:
    """Greedy tiles from all maximal matches (place in item, place in text, length)."""
    queue = list(zip((-lengths).tolist(), at_item.tolist(), at_text.tolist(), strict=True))
    heapq.heapify(queue)
    free_item, free_text = np.ones(item_words, dtype=bool), np.ones(text_words, dtype=bool)
    out, left = [], item_words
    while queue and left >= least:
        length, x, y = heapq.heappop(queue)
        length = -length
        free = free_item[x:x + length] & free_text[y:y + length]
        if free.all():
            free_item[x:x + length] = free_text[y:y + length] = False
            out.append((x, y, length))
            left -= length
            continue
        edge = np.diff(np.concatenate(([0], free.astype(np.int8), [0])))
        for p, q in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if q - p >= least:
                heapq.heappush(queue, (p - q, x + p, y + p))
    return out


def index_items(ids: list[int], texts: list[str | None]) -> Items:
    """The index of some items; their texts are cut into words as the documents are."""
    parts = []
    for _, _, data, offsets in slices(pa.array(texts, type=pa.string())):
        words, first = word_hashes(data, offsets, MARKS)
        parts += [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    some = [k for k, w in enumerate(parts) if len(w) >= TILE]
    parts = [parts[k] for k in some]
    seeds = [sequence_hashes(w, TILE) for w in parts]
    first = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in parts], out=first[1:])
    every = np.concatenate([*seeds, np.zeros(0, np.uint64)])
    place = np.concatenate([*[np.arange(len(x)) for x in seeds], np.zeros(0, np.int64)]).astype(np.int64)
    before = np.concatenate([*[np.append(w[:1], w)[:len(x)] for w, x in zip(parts, seeds, strict=True)], np.zeros(0, np.uint64)])
    order = np.lexsort((before, place > 0, every))
    return Items(
        np.array([ids[k] for k in some], dtype=np.int64), np.concatenate([*parts, np.zeros(0, np.uint64)]), first, every[order],
        np.repeat(np.arange(len(parts)), [len(x) for x in seeds])[order], place[order], before[order])


def _bound(items: Items, low: np.ndarray, high: np.ndarray, word: np.ndarray, beyond: bool) -> np.ndarray:
    """In each range of equal seeds the first one whose word before is ``word`` or more (``beyond``: more)."""
    low, high = low.copy(), high.copy()
    while len(some := np.flatnonzero(low < high)):
        middle = (low[some] + high[some]) // 2
        less = items.before[middle] <= word[some] if beyond else items.before[middle] < word[some]
        less |= items.place[middle] == 0
        low[some[less]] = middle[less] + 1
        high[some[~less]] = middle[~less]
    return low


def _lengths(one: np.ndarray, other: np.ndarray, at_one: np.ndarray, at_other: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Equal words from the places on, at most ``room`` (1 or more)."""
    out = np.zeros(len(room), dtype=np.int64)
    for begin in range(0, len(room), 1 << 14):
        alive, done, step = np.arange(begin, min(begin + (1 << 14), len(room))), 0, 2 * TILE
        while len(alive):
            ahead = done + np.arange(step)
            inside = ahead < room[alive, None]
            i, j = np.minimum(at_one[alive, None] + ahead, len(one) - 1), np.minimum(at_other[alive, None] + ahead, len(other) - 1)
            equal = (one[i] == other[j]) & inside
            stop = ~equal.all(axis=1)
            out[alive[stop]] = done + equal[stop].argmin(axis=1)
            alive, done, step = alive[~stop], done + step, 64
    return out


def _covered(places: np.ndarray, lengths: np.ndarray, words: int) -> int:
    """Words of an item that some match covers."""
    hit = np.zeros(words + 1, dtype=np.int64)
    np.add.at(hit, places, 1)
    np.add.at(hit, places + lengths, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def matches(words: np.ndarray, seeds: np.ndarray, items: Items, sieve: np.ndarray, coverage: float):
    """(item number, covered share, tiles) of the items that contaminate one text."""
    maybe = np.flatnonzero(sieve[(seeds & np.uint64(len(sieve) - 1)).astype(np.int64)])
    low = np.searchsorted(items.seeds, seeds[maybe], side="left")
    high = np.searchsorted(items.seeds, seeds[maybe], side="right")
    maybe, low, high = (x[low < high] for x in (maybe, low, high))
    if not len(maybe):
        return
    # a match begins where the words before differ: of the equal seeds, those below and above the text's word before
    word, begins = words[maybe - 1], maybe == 0
    below = np.where(begins, high, _bound(items, low, high, word, False))
    above = np.where(begins, high, _bound(items, low, high, word, True))
    start, stop, text_at = np.concatenate([low, above]), np.concatenate([below, high]), np.concatenate([maybe, maybe])
    count = stop - start
    text_at = np.repeat(text_at, count)
    entry = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    number, item_at = items.item[entry], items.place[entry]
    room = np.minimum(items.first[number + 1] - items.first[number] - item_at, len(words) - text_at)
    lengths = _lengths(items.words, words, items.first[number] + item_at, text_at, room)
    same = lengths >= TILE  # the hashes found them, the words must agree
    number, item_at, text_at, lengths = number[same], item_at[same], text_at[same], lengths[same]
    order = np.argsort(number, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
        k = int(number[part[0]])
        size = int(items.first[k + 1] - items.first[k])
        if _covered(item_at[part], lengths[part], size) < coverage * size:
            continue  # tiles cover no more than matches do
        found = marked(size, len(words), item_at[part], text_at[part], lengths[part])
        share = sum(x[2] for x in found) / size
        if share >= coverage:
            yield k, share, found


FOUND = [
    StructField("n_items", IntegerType()), StructField("item_id", LongType()), StructField("coverage", DoubleType()),
    StructField("tiles", ArrayType(StructType([StructField(x, IntegerType()) for x in ("item_start", "text_start", "length")])))]


def _searched(rows: DataFrame, shared: Broadcast, coverage: float) -> DataFrame:
    """Rows with what the items of one block add to the columns FOUND."""
    names = rows.columns
    text_at, mine = names.index("text"), [names.index(f.name) for f in FOUND]
    tile = pa.list_(pa.struct([(x, pa.int32()) for x in ("item_start", "text_start", "length")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pickle.loads(zlib.decompress(shared.value))
        sieve = np.zeros(1 << _FILTER_BITS, dtype=bool)
        sieve[(items.seeds & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
        for batch in batches:
            n, item, share, tiling = (batch.column(k).to_pylist() for k in mine)
            for i, j, data, offsets in slices(batch.column(text_at)):
                words, first = word_hashes(data, offsets, MARKS)
                seeds = sequence_hashes(words, TILE)
                hit = sieve[(seeds & np.uint64(len(sieve) - 1)).astype(np.int64)]
                hit = np.append(0, np.cumsum(hit))
                for k, a, b in zip(range(i, j), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    end = b - TILE + 1
                    if end <= a or hit[end] == hit[a]:
                        continue
                    for number, covered, found in matches(words[a:b], seeds[a:end], items, sieve, coverage):
                        name = int(items.ids[number])
                        n[k] += 1
                        if item[k] is None or (covered, -name) > (share[k], -item[k]):
                            item[k], share[k] = name, covered
                            tiling[k] = [dict(zip(("item_start", "text_start", "length"), x, strict=True)) for x in found]
            columns = list(batch.columns)
            for k, values, kind in zip(mine, (n, item, share, tiling), (pa.int32(), pa.int64(), pa.float64(), tile), strict=True):
                columns[k] = pa.array(values, type=kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(work, rows.schema)


def contamination(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """All columns of the documents, and n_items, item_id, coverage and tiles of every row.

    ``n_items`` counts the benchmark items of whose words tiles cover at least ``coverage``;
    the others tell of the best covered one (the smaller item_id where equal; NULL without any),
    tiles longest first with places counted in words. Words are runs of letters and digits; case
    of ASCII letters does not matter. Null and empty texts have no words; items without an
    item_id or with fewer than ``TILE`` words are not searched; items that repeat are counted
    each. Items are searched in blocks of about ``BLOCK_BYTES``, each broadcast, so documents are
    read once and never dealt anew. Columns of the documents with these names are replaced.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = documents.withColumns({f.name: F.lit(0 if f.name == "n_items" else None).cast(f.dataType) for f in FOUND})
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for k in range(blocks):
        part = sorted(items.where(block == k).collect(), key=lambda r: (r.item_id, r.text))
        shared = zlib.compress(pickle.dumps(index_items([r.item_id for r in part], [r.text for r in part])), 1)
        rows = _searched(rows, spark.sparkContext.broadcast(shared), coverage)
    return rows


def clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all columns, that no benchmark item contaminates."""
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    return contamination(boxed, benchmark, coverage).where("n_items = 0").select("_row.*")


def report(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, coverage and n_tiles of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return contamination(rows, benchmark, coverage).select(
        "doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "coverage",
        F.coalesce(F.size("tiles"), F.lit(0)).alias("n_tiles"))
