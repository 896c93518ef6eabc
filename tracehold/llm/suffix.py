"""Removal of byte strings that occur twice, by run-length BWT indexes over shards of the corpus.

A window (a string of the given length) is filed under its minimizer: the place in it whose
k-byte gram hashes lowest. Equal windows have equal minimizers, so windows filed under different
grams need no comparison. Consecutive windows with one minimizer form a segment. A gram that
occurs once is done with; segments that are equal whole are repeated whole; the distinct segments
of a gram go to one shard, where they are indexed together (of a gram with very many, strings under
a core of bytes that they share: equal ones are counted, distinct ones are indexed, and where these
are very many too, their single windows are counted): suffixes sorted, the Burrows-Wheeler
transform cut into runs, suffixes sampled at the run ends, and the longest match of every
position streamed from the samples (within a run a match shrinks by one byte per step).
Every position whose match is as long as a window is marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import drop_stored, mix, powers, stored, text_bytes

#: Bytes of a gram. Fewer: more grams shared by chance; more: more segments.
GRAM = 64
#: Window starts that one numpy step works on.
STEP = 1 << 18
#: Bytes of segments that are indexed at once; a gram's segments stay together.
INDEX_BYTES = 2 << 20
#: Distinct segments of a gram beyond which windows are filed under the bytes they share.
WIDE_GRAM = 200
#: Window starts that are filed together for such a gram.
BAND = 8
#: Distinct strings under one core beyond which single windows are counted.
WIDE_CORE = 200
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_POSITION = np.uint64((1 << 24) - 1)
SEGMENT = "doc_id long, text_key long, start long, length int, place int, gram long, content long"


def _sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def segments(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Segments of some texts' bytes: first byte, length, place of the gram, gram and content hash.

    ``ends`` are the ends of the texts in ``data``; no window crosses one.
    """
    n, width = len(data), window - gram + 1
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    sums = [_sums(data, b) for b in _BASES]
    grams = n - gram + 1
    hashes = mix((sums[0][gram:] - sums[0][:grams]) * powers(_INVERSES[0], grams))
    low = (hashes & ~_POSITION) | np.arange(grams, dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    places = (low & _POSITION).astype(np.int64)
    end = np.repeat(ends, np.diff(ends, prepend=0))[:len(places)]
    inside = np.arange(window, len(places) + window) <= end
    change = np.ones(len(places), dtype=bool)
    change[1:] = (places[1:] != places[:-1]) | (end[1:] != end[:-1])
    first = np.flatnonzero(change & inside)
    last = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
    stop = last + window
    content = np.zeros(len(first), dtype=np.uint64)
    for one, base in zip(sums, _INVERSES, strict=True):
        content = mix(content ^ ((one[stop] - one[first]) * powers(base, n)[first]))
    at = places[first]
    return first, stop - first, at - first, hashes[at].view(np.int64), mix(content + (stop - first).astype(np.uint64)).view(np.int64)


def find_segments(documents: DataFrame, window: int = 200, gram: int = GRAM) -> DataFrame:
    """Every text's segments: doc_id, text_key, start, length, place, gram and content hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            owners, ids, keys = _pieces(offsets, window), batch.column(0), batch.column(2)
            for rows, a, b, ends in owners:
                found = segments(data[a:b], ends - a, window, gram)
                row = rows[0] + np.searchsorted(ends - a, found[0], side="right")
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), keys.take(take), pa.array(found[0] + a - offsets[row]),
                    pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)),
                    pa.array(found[3]), pa.array(found[4])], [x.split()[0] for x in SEGMENT.split(", ")])

    return documents.mapInArrow(work, SEGMENT)


def _pieces(offsets: np.ndarray, window: int):
    """((first row, end row), first byte, end byte, ends of texts): short texts together, long ones cut.

    Cuts of a long text overlap by a window less one byte, so that each window is in one piece.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > STEP:
            a, end = int(offsets[i]), int(offsets[i + 1])
            while a + window <= end:
                b = min(end, a + STEP + window - 1)
                yield (i, i + 1), a, b, np.array([b])
                a += STEP
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= STEP:
            j += 1
        yield (i, j), int(offsets[i]), int(offsets[j]), offsets[i + 1:j + 1]
        i = j


class RunIndex:
    """A run-length BWT of some segments with sampled run ends."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum(sizes, out=self.starts[1:])
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n = len(data)
        self.size = n
        self.end = np.repeat(self.starts[1:], sizes)  # end of each position's segment
        order = self._sorted(data, n)
        before = np.concatenate(([-1], data[:-1].astype(np.int16)))
        before[self.starts[:-1]] = -1  # what stands before a segment differs from everything
        before = before[order]
        heads = np.ones(n, dtype=bool)
        heads[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        at = np.flatnonzero(heads)
        self.runs = len(at)
        # sampled suffixes on both sides of each border between runs, and their common prefix
        self.heads = order[at]
        self.tails = order[at[1:] - 1]
        self.common = np.zeros(len(at), dtype=np.int64)
        self.common[1:] = self._extend(data, self.heads[1:], self.tails)

    def _sorted(self, data: np.ndarray, n: int) -> np.ndarray:
        """Suffix array by doubling; a suffix ends with its segment, equal ones keep text order."""
        key, place = np.zeros(n, dtype=np.uint64), np.arange(n)
        for j in range(7):
            inside = place + j < self.end
            symbol = np.zeros(n, dtype=np.uint64)
            symbol[inside] = data[place[inside] + j].astype(np.uint64) + np.uint64(1)
            key = (key << np.uint64(9)) | symbol
        order = np.argsort(key, kind="stable")
        length, longest = 7, int((self.end - place).max()) if n else 0
        ranked = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.flatnonzero(new)  # rank: place of the group's first member
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.repeat(group, np.diff(np.append(group, n)))
        while length < longest:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order not settled
            if not len(tied):
                break
            some = order[tied]
            follow = some + length
            after = np.where(follow < self.end[some], rank[np.minimum(follow, n - 1)] + 1, 0)
            both = rank[some] * np.int64(n + 1) + after
            inner = np.argsort(both, kind="stable")
            order[tied], both = some[inner], both[inner]
            fresh = np.ones(len(tied), dtype=bool)
            fresh[1:] = both[1:] != both[:-1]
            new[tied] = fresh
            first = np.flatnonzero(fresh)
            rank[order[tied]] = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
            length *= 2
        return order

    def _extend(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, within their segments."""
        padded = np.append(data, np.zeros(8, dtype=np.uint8))
        eight = np.zeros(self.size + 1, dtype=np.uint64)
        for j in range(8):
            eight = (eight << np.uint64(8)) | padded[j:j + self.size + 1]
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        out, alive, off = room.copy(), np.arange(len(a)), 0
        while len(alive):
            differ = eight[a[alive] + off] ^ eight[b[alive] + off]
            stop = differ != 0
            same = (differ[stop].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            gone = alive[stop]
            out[gone] = np.minimum(room[gone], off + same)
            off += 8
            alive = alive[~stop]
            alive = alive[room[alive] > off]
        return out

    def longest_matches(self) -> np.ndarray:
        """For every position the length of its longest match elsewhere, streamed from the samples."""
        best, place = np.zeros(self.size, dtype=np.int64), np.arange(self.size)
        first = np.repeat(self.starts[:-1], np.diff(self.starts))
        for places, lengths in ((self.heads, self.common), (self.tails, self.common[1:])):
            sample = np.full(self.size, -1, dtype=np.int64)
            sample[places] = places
            value = np.zeros(self.size, dtype=np.int64)
            value[places] = lengths
            last = np.maximum.accumulate(sample)
            best = np.maximum(best, np.where(last >= first, value[last] - (place - last), 0))
        return best


def repeated_spans(parts: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each part the spans covered by strings of ``window`` bytes that start at another place too."""
    index = RunIndex(parts)
    long = index.longest_matches() >= window
    edge = np.diff(np.concatenate(([0], long.astype(np.int8), [0])))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(index.starts, first, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for p, a, b in zip(owner.tolist(), first.tolist(), stop.tolist(), strict=True):
        base = int(index.starts[p])
        out[p].append((a - base, b - 1 - base + window))
    return out


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Distinct segments' bytes, filed: shard key, gram, content, offset in the segment, bytes, whether cut into bands."""
    schema = "shard long, gram long, content long, low int, body binary, wide boolean"

    def filed(bytes_: bytes, place: int) -> Iterator[tuple[int, int, bytes]]:
        """Bands of window starts at fixed distances before the gram, under the bytes all share."""
        last = len(bytes_) - window
        for band in range((place - last) // BAND, place // BAND + 1):
            a, b = max(0, place - band * BAND - BAND + 1), min(last, place - band * BAND)
            if a <= b:
                core = bytes_[max(0, place - band * BAND):place - band * BAND - BAND + 1 + window]
                name = hashlib.blake2b(core, digest_size=8, person=b"%d" % band).digest()
                yield int.from_bytes(name, "little", signed=True), a, bytes_[a:b + window]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                body = (text.as_py() or "").encode()
                rows = []
                for part in wanted.as_py():
                    piece = body[part["start"]:part["start"] + part["length"]]
                    if part["wide"]:
                        rows += [(s, part["gram"], part["content"], a, x, True) for s, a, x in filed(piece, part["place"])]
                    else:
                        rows.append((part["gram"], part["gram"], part["content"], 0, piece, False))
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(
                        zip(*rows[i:i + 5000], strict=True),
                        (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)],
                        ["shard", "gram", "content", "low", "body", "wide"])

    return texts.mapInArrow(work, schema)


def _indexed(filed: DataFrame, window: int) -> DataFrame:
    """(gram, content, begin, end, band): spans of distinct segments or bands that match elsewhere.

    Rows come sorted by shard, which has a bounded number of them; so many bytes are indexed at once, whole shards only.
    Rows that repeat a doc_id and its text file the same segments: one of them is held.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes, bool]] = []
        seen: set[tuple[int, int, int]] = set()  # of the last shard
        size = 0

        def answer(rows: list) -> pa.RecordBatch:
            spans = repeated_spans([r[4] for r in rows], window)
            out = [(r[1], r[2], r[3] + a, r[3] + b, r[5]) for r, found in zip(rows, spans, strict=True) for a, b in found]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)],
                ["gram", "content", "begin", "end", "band"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and held[-1][0] != row[0]:
                    yield answer(held)
                    held, size = [], 0
                if not held or held[-1][0] != row[0]:
                    seen.clear()
                if row[1:4] in seen:
                    continue
                seen.add(row[1:4])
                held.append(row)
                size += len(row[4])
        if held:
            yield answer(held)

    return filed.mapInArrow(work, "gram long, content long, begin int, end int, band boolean")


def _matched(filed: DataFrame, window: int) -> DataFrame:
    """(gram, content, begin, end): spans of filed rows (as of ``_cut``, stored) that match elsewhere.

    Bands with equal bytes are counted and repeated whole; only distinct ones are compared further.
    """
    spark = filed.sparkSession
    filing = ["shard", "gram", "content", "low", "body"]
    bands = filed.where("wide")
    bodies, bodies_path = stored(bands.groupBy("shard", "body").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", F.xxhash64("body").alias("key"), "n", "body"), "band-bodies")
    cores, cores_path = stored(bodies.groupBy("shard").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(
        "shard", (F.col("_k") > WIDE_CORE).alias("many")), "band-cores")
    compared, compared_path = stored(bodies.join(cores, "shard").select("shard", "key", "body", "many"), "compared-bodies")

    few = compared.where("NOT many").select("shard", F.col("shard").alias("gram"), F.col("key").alias("content"), F.lit(0).alias("low"), "body")
    narrow = filed.where("NOT wide").select(*filing)
    indexed = narrow.withColumn("band", F.lit(False)).unionByName(few.withColumn("band", F.lit(True)))
    size = indexed.agg(F.sum(F.length("body"))).first()[0] or 0
    tasks = max(1, -(-size // (4 * INDEX_BYTES)))
    found, found_path = stored(_indexed(indexed.repartition(tasks, "shard").sortWithinPartitions("shard"), window), "indexed-spans")

    single = compared.where("many").select("shard", "key", "body", F.explode(
        F.sequence(F.lit(0), F.length("body") - window)).alias("begin"))
    string = F.substring("body", F.col("begin") + 1, F.lit(window))
    single = single.select("shard", "key", "begin", F.xxhash64(string).alias("_x"), F.hash(string).alias("_y"))
    name = ["shard", "_x", "_y"]
    twice, twice_path = stored(single.groupBy(*name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*name), "repeated-windows")
    spans = single.join(twice, name).select("shard", "key", "begin", (F.col("begin") + window).alias("end")).unionByName(
        bodies.where("n > 1").select("shard", "key", F.lit(0).alias("begin"), F.length("body").alias("end"))).unionByName(
        found.where("band").select(F.col("gram").alias("shard"), F.col("content").alias("key"), "begin", "end"))
    spans, spans_path = stored(spans.groupBy("shard", "key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "band-spans")
    of_bands = bands.select("shard", F.xxhash64("body").alias("key"), "gram", "content", "low").join(
        spans, ["shard", "key"]).select("gram", "content", "low", F.explode("spans").alias("_s")).select(
        "gram", "content", (F.col("low") + F.col("_s.begin")).alias("begin"), (F.col("low") + F.col("_s.end")).alias("end"))
    marks, _ = stored(of_bands.unionByName(found.where("NOT band").drop("band")), "matched-spans")
    drop_stored(spark, bodies_path, cores_path, compared_path, found_path, twice_path, spans_path)
    return marks


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def repeated_strings(documents: DataFrame, window: int = 200, gram: int = GRAM) -> DataFrame:
    """doc_id, text and spans (merged byte spans begin, end, ascending) of every row.

    Spans cover each byte of a string of ``window`` UTF-8 bytes that starts at another place of the
    corpus too, the same text included; overlaps count. Null texts are empty. Rows that repeat
    another's doc_id and text, and rows without a doc_id, count as texts of their own. Other
    columns are not read.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram is at most as long as a window")
    rows = _rows(documents)
    found, found_path = stored(find_segments(rows, window, gram), "segments")
    grams = found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("_n"), F.min("content").alias("_a"), F.max("content").alias("_b")).where("_n > 1")
    # stored, so that the join deals both sides itself and can split a gram of very many segments
    grams, grams_path = stored(grams.select("gram", (F.col("_a") != F.col("_b")).alias("several")), "grams")
    shared, _ = stored(found.join(grams, "gram"), "shared-segments")
    drop_stored(documents.sparkSession, found_path, grams_path)
    owner = ["doc_id", "text_key"]
    whole = F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("length")).alias("end"))
    alike = shared.where(~F.col("several")).select(*owner, F.array(whole).alias("spans"))

    several = shared.where("several")
    distinct = several.groupBy("gram", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*owner, "start", "length", "place")).alias("one"))
    distinct, _ = stored(distinct, "distinct-segments")
    wide, _ = stored(distinct.groupBy("gram").agg((F.count(F.lit(1)) > WIDE_GRAM).alias("wide")), "wide-grams")
    wanted = distinct.join(wide, "gram").groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key")).agg(
        F.collect_list(F.struct("gram", "content", "one.start", "one.length", "one.place", "wide")).alias("wanted"))
    texts = _owned(rows, wanted, "inner").select("text", "wanted")
    filed, filed_path = stored(_cut(texts, window), "filed-segments")
    marks = _matched(filed, window)
    drop_stored(documents.sparkSession, filed_path)
    marks = marks.unionByName(distinct.where("n > 1").select(
        "gram", "content", F.lit(0).alias("begin"), F.col("one.length").alias("end")))
    marks = marks.groupBy("gram", "content").agg(F.collect_set(F.struct("begin", "end")).alias("marks"))
    # one more key than marks are grouped by: the join deals both sides itself and can split a segment of very many copies
    both = F.xxhash64("gram", "content")
    unlike = several.withColumn("_both", both).join(marks.withColumn("_both", both), ["_both", "gram", "content"]).select(*owner, F.transform("marks", lambda m: F.struct(
        (F.col("start") + m["begin"]).alias("begin"), (F.col("start") + m["end"]).alias("end"))).alias("spans"))
    # rows that repeat a doc_id and its text mark the same spans: a set, so that k such rows do not get the marks of all k each
    removed = alike.unionByName(unlike).groupBy(*owner).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return _owned(rows, removed, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(
        "array<struct<begin:bigint,end:bigint>>")).alias("spans"))


def _owned(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Rows joined with what belongs to their doc_id (null included) and text."""
    more = more.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), how)


def removed_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 from ``repeated_strings``."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_ in zip(batch.column(1), batch.column(2), strict=True):
                body, kept, at, n = text.as_py().encode(), hashlib.sha256(), 0, 0
                merged = merge((s["begin"], s["end"]) for s in spans_.as_py())
                for a, b in merged:
                    kept.update(body[at:a])
                    at, n = b, n + b - a
                kept.update(body[at:])
                out.append((len(body), n, len(merged), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.select("doc_id", "text", "spans").mapInArrow(work, schema)


def merge(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
