"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary text, back off from bigrams to words of their class
and, by the words' stems, to continuation counts that both share and that are gathered from all
documents: an expression that a class has hardly seen is about as likely in one as in the other. Words and pairs of
words count by the different words before them, less a discount of a few whole counts: what few
texts show, or any number of copies of one, is left to the shared counts. A text is
described by its log-likelihood ratio per word, over all of it and over its most toxic passage;
a logistic function, fitted on labelled rows that the models have not seen, makes it a score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracehold.llm.common import MARKS, STEP_BYTES, distinct, drop_stored, mix, slices, stored, word_hashes

#: Bits of a word before that count as its name, bits more for a pair of words of which the sample lacks the second, and
#: parts that pairs of words are dealt to.
BEFORE_BITS, OTHER_BITS, PART_BITS = 30, 18, 12
#: Pairs of words that a task holds before it sends them.
HELD_CODES = 1 << 21
#: Bytes of text that one step of scoring works on; the counts take longer steps, which drop more of what repeats.
SHORT_STEP = 1 << 18
#: Labelled rows that the models and the score are fitted on, about so many of each class at most.
TOXIC_ROWS, ORDINARY_ROWS = 8_000, 16_000
#: Contexts of a word or of a pair of words that are left to the backoff.
DISCOUNT = 6
#: Bytes of a word that are its stem.
STEM = 4
#: Words of a passage.
PASSAGE = 2
#: Every fifth labelled row of a class fits the score, the others the models.
SCORE_FOLDS = 5


class Names:
    """Places of known 64-bit hashes in ascending order; all others have the place after the last."""

    def __init__(self, known: np.ndarray):
        known = distinct(known.astype(np.uint64))
        bits = max(1, (2 * len(known)).bit_length())
        self.size, self.shift = len(known), np.uint64(64 - bits)
        self.starts = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.known = np.append(known, np.uint64(0xFFFFFFFFFFFFFFFF))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = self.starts[hashes >> self.shift]
        behind = np.flatnonzero(self.known[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.known[at[behind]] < hashes[behind]]
        return np.where(self.known[at] == hashes, at, self.size)


class Model(NamedTuple):
    """Tables of the sample's words, pairs and stems, and one more place for all others; index 0 toxic, 1 ordinary."""

    words: Names
    stems: Names
    pairs: Names
    word: np.ndarray  # 2 x words: discounted share of the contexts
    rest: np.ndarray  # 2: what the discount took
    stem: np.ndarray  # 2 x stems: how much likelier than in both classes together
    shared: np.ndarray  # words: the shared distribution
    seen: np.ndarray  # 2 x words: times as a first word
    cut: np.ndarray  # 2 x words: what the discount took from the counts after it
    pair: np.ndarray  # 2 x pairs: discounted count
    weights: np.ndarray  # of the logistic function


def _words(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES):
    """(row range, word hashes, first word of each row, stem hashes) step by step."""
    for i, j, data, offsets in slices(batch.column(column), limit):
        words, first, stems = word_hashes(data, offsets, MARKS, STEM)
        yield i, j, words, first, stems


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name of each pair of places; different pairs have different names."""
    return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


def _followers(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of words that have a word before them in their row."""
    inner = np.ones(len(words), dtype=bool)
    inner[first[:-1][first[:-1] < len(words)]] = False
    return np.flatnonzero(inner)


def _packed_gaps(gaps: np.ndarray) -> bytes:
    """Differences as 32 low bits each, then places and high bits of the few that have more, then how many these are."""
    long = np.flatnonzero(gaps >> 32)
    return b"".join(x.astype("<u4").tobytes() for x in (gaps & 0xFFFFFFFF, long, gaps[long] >> 32, np.array([len(long)])))


def _gaps(blob: bytes) -> np.ndarray:
    numbers = np.frombuffer(blob, "<u4").astype(np.int64)
    n = numbers[-1]
    gaps, long, high = np.split(numbers[:-1], [len(numbers) - 1 - 2 * n, len(numbers) - 1 - n])
    gaps[long] += high << 32
    return gaps


def vocabulary(sample: DataFrame) -> tuple[Names, Names]:
    """The different words, and stems, of a bounded sample of texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, _, stems in _words(batch, 0):
                for stem, some in ((False, words), (True, stems)):
                    some = distinct(some).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), stem)), pa.array(some)], ["stem", "name"])

    rows = sample.select("text").mapInArrow(work, "stem boolean, name long").distinct().toArrow()
    stem, name = rows["stem"].to_numpy().astype(bool), rows["name"].to_numpy().astype(np.int64).view(np.uint64)
    return Names(name[~stem]), Names(name[stem])


def shared_counts(documents: DataFrame, words: Names) -> DataFrame:
    """(word, contexts): how many different words stand before a word, over all documents, by the word's place.

    Words that ``words`` lacks are counted together under the place after the last: all their pairs with a
    word before. Words before are told apart by ``BEFORE_BITS`` bits of their hashes, so n of them are counted too
    low by a share of n / 2**(BEFORE_BITS + 1); the pairs that are counted together are told apart by
    ``BEFORE_BITS + OTHER_BITS`` bits of a hash of both. A task sends its different pairs once, sorted and as differences, dealt to parts of even size.
    """
    low, parts = np.int64((1 << BEFORE_BITS) - 1), np.int64((1 << PART_BITS) - 1)
    known, bucket_shift = words.size, np.int64(BEFORE_BITS - PART_BITS)
    bucket_bits = (known + (1 << OTHER_BITS)).bit_length()
    sent = _sent(documents.sparkSession, words)

    def packed(codes: np.ndarray) -> pa.RecordBatch:
        edges = np.searchsorted(codes >> (bucket_bits + bucket_shift), np.arange(parts + 2))
        some = np.flatnonzero(np.diff(edges))
        blobs = []
        for i in some.tolist():
            gaps = np.diff(codes[edges[i]:edges[i + 1]], prepend=i << int(bucket_bits + bucket_shift))
            blobs.append(_packed_gaps(gaps))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(blobs, pa.binary())], ["part", "codes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = _unpacked(sent), [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words, first = word_hashes(data, offsets, MARKS)
                at = _followers(words, first)
                place = names.places(words[at])
                both = np.where(place < known, words[at - 1], mix(words[at] + mix(words[at - 1])))
                other = ((both >> np.uint64(64 - BEFORE_BITS - OTHER_BITS)) & np.uint64((1 << OTHER_BITS) - 1)).astype(np.int64)
                bucket = np.where(place < known, place, known + other)
                before = (both >> np.uint64(64 - BEFORE_BITS)).astype(np.int64)
                # a part, a bucket and the upper bits tell the lower bits of the word before
                part = (before ^ mix(bucket.astype(np.uint64)).view(np.int64)) & parts
                held.append(distinct((((part << bucket_bits) | bucket) << bucket_shift) | ((before & low) >> PART_BITS)))
                size += len(held[-1])
                if size > HELD_CODES:
                    held = [distinct(*held)]
                    size = len(held[0])
                    if size > HELD_CODES // 2:
                        yield packed(held[0])
                        held, size = [], 0
        if size:
            yield packed(distinct(*held))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def answer() -> pa.RecordBatch:
            bucket, n = np.unique(distinct(*held) >> bucket_shift, return_counts=True)
            bucket = bucket & np.int64((1 << bucket_bits) - 1)
            own = bucket < known
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(bucket[own], known)), pa.array(np.append(n[own], n[~own].sum()))], ["word", "contexts"])

        for batch in batches:
            for now, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and now != part:
                    yield answer()
                    held, size = [], 0
                part = now
                gaps = _gaps(blob)
                held.append(np.cumsum(gaps))
                size += len(gaps)
                if size > HELD_CODES:
                    held = [distinct(*held)]
                    size = 0  # so many more before the next time
        if held:
            yield answer()

    rows = documents.select(F.col("text").cast("string").alias("text"))
    dealt = rows.mapInArrow(work, "part long, codes binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(counted, "word long, contexts long").groupBy("word").agg(F.sum("contexts").alias("contexts"))


def _counts(sample: DataFrame, words: Names, stems: Names | None = None) -> DataFrame:
    """(toxic, left, right, n) over rows (text, toxic): the different words before a pair of words, by places.

    left is -1 where right begins a text. Or with ``stems`` (toxic, stem, n): the different words before a stem.
    Words before a pair are told apart by the hash bits that two places leave of 62.
    """
    sent = _sent(sample.sparkSession, (words, stems))
    bits = (words.size + 1).bit_length()
    last_bits = stems.size.bit_length() if stems else bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = _unpacked(sent)
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            for i, j, hashes, first, stem_hashes in _words(batch, 0):
                if not len(hashes):
                    continue
                size = np.diff(first)
                place = words.places(hashes)
                left = np.append(0, place[:-1] + 1)
                left[first[:-1][size > 0]] = 0
                if stems:
                    code = (left << last_bits) | stems.places(stem_hashes)
                else:
                    before = np.append(0, left[:-1])
                    before[left == 0] = 0
                    before = (mix(before.astype(np.uint64)) >> np.uint64(2 + 2 * bits)).astype(np.int64)
                    code = (before << (2 * bits)) | (left << bits) | place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct(code | (np.repeat(toxic[i:j], size) << 62)))], ["code"])

    codes = sample.select("text", "toxic").mapInArrow(work, "code long").distinct()
    toxic = F.shiftright("code", 62).cast("int").alias("toxic")
    last = F.col("code").bitwiseAND(F.lit((1 << last_bits) - 1)).cast("int")
    if stems:
        return codes.groupBy(toxic, last.alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    left = (F.shiftright("code", bits).bitwiseAND(F.lit((1 << bits) - 1)) - 1).cast("int").alias("left")
    return codes.groupBy(toxic, left, last.alias("right")).agg(F.count(F.lit(1)).alias("n"))


def _dense(frame: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """A table of the sample (one row for each class and place at most) as an array, with the place of all others."""
    out = np.zeros((2, size + 1))
    rows = frame.select((1 - F.col("toxic")).alias("c"), F.col(key).cast("int").alias("k"), F.col(value).cast("float").alias("v")).toArrow()
    np.add.at(out, (rows["c"].to_numpy(), rows["k"].to_numpy()), rows["v"].to_numpy())
    return out


def fit_models(documents: DataFrame, sample: DataFrame) -> Model:
    """The models from all documents' shared counts and a bounded sample (text, toxic) of labelled rows.

    Tables have the size of the sample's vocabulary. A word that the sample lacks has only its shared share,
    which is the same in both classes and leaves their ratio alone: the counts of such words enter the total only.
    """
    names, stem_names = vocabulary(sample)
    shared = shared_counts(documents, names).toArrow()  # one row per word of the sample, and one
    contexts = np.ones(names.size + 1)  # words never seen have one context
    contexts[shared["word"].to_numpy()] += shared["contexts"].to_numpy()
    backoff = contexts / contexts.sum()

    pairs, pairs_path = stored(_counts(sample, names), "pair-counts")
    words = pairs.groupBy("toxic", F.col("right").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    contexts_of = _dense(words, "word", "n", names.size)
    word, rest = _discounted(contexts_of)
    stems = _dense(_counts(sample, names, stem_names), "stem", "n", stem_names.size)
    stem, stem_rest = _discounted(stems)
    both = (stems / np.maximum(stems.sum(axis=1, keepdims=True), 1)).mean(axis=0)
    stem = np.where(both > 0, (stem + stem_rest[:, None] * both) / np.maximum(both, 1e-300), 1.0)
    inner = pairs.where("left >= 0")
    kept = F.greatest(F.col("n") - DISCOUNT, F.lit(0)).cast("double")
    # a first word after which nothing is left of the counts says no more than the second word alone
    heads = inner.groupBy("toxic", "left").agg(F.sum("n").alias("n"), F.sum(kept).alias("kept")).where("kept > 0").select(
        "toxic", "left", "n", (F.col("n") - F.col("kept")).alias("cut"))
    heads, heads_path = stored(heads, "first-words")
    pair_names, pair = _pairs(inner.select("toxic", "left", "right", kept.alias("n")).where("n > 0"))
    model = Model(
        names, stem_names, pair_names, word.astype(np.float32), rest, stem.astype(np.float32), backoff.astype(np.float32),
        _dense(heads, "left", "n", names.size).astype(np.float32), _dense(heads, "left", "cut", names.size).astype(np.float32),
        pair.astype(np.float32), np.zeros(0))
    drop_stored(documents.sparkSession, pairs_path, heads_path)
    return model


def _discounted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each class's shares less the discount, and what it took in all (1 of an empty class)."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    shares = np.maximum(counts - DISCOUNT, 0) / total
    return shares, 1 - shares.sum(axis=1)


def _pairs(counts: DataFrame) -> tuple[Names, np.ndarray]:
    """Names of the sample's pairs of which the discount leaves something, and what it leaves."""
    rows = counts.toArrow()
    toxic, left, right, n = (rows[x].to_numpy() for x in ("toxic", "left", "right", "n"))
    names = Names(_pair(left, right))
    out = np.zeros((2, names.size + 1))
    np.add.at(out, (1 - toxic, names.places(_pair(left, right))), n)
    return names, out


def _features(model: Model, words: np.ndarray, first: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Per row: 1, ratio per word of the whole text, ratio per word of the most toxic passage."""
    n = len(words)
    ratio = np.zeros(n)
    if n:
        words, stems = model.words.places(words), model.stems.places(stems)
        shared = model.shared[words].astype(np.float64)
        p = model.word[:, words] + model.rest[:, None] * model.stem[:, stems] * shared
        at = _followers(words, first)
        left, right = words[at - 1], words[at]
        pair = model.pair[:, model.pairs.places(_pair(left, right))]
        seen = model.seen[:, left]
        p[:, at] = np.where(seen > 0, (np.minimum(pair, seen) + model.cut[:, left] * p[:, at]) / np.maximum(seen, 1), p[:, at])
        ratio = np.log(p[0]) - np.log(p[1])
    out = np.zeros((len(first) - 1, 3))
    out[:, 0] = 1
    sums = np.append(0, np.cumsum(ratio))
    size = np.diff(first)
    some = size > 0
    out[some, 1] = (sums[first[1:]] - sums[first[:-1]])[some] / size[some]
    if n:
        # passages begin at every word and end with the row at the latest
        end = np.minimum(np.arange(n) + PASSAGE, np.repeat(first[1:], size))
        passage = (sums[end] - sums[:-1]) / np.minimum(PASSAGE, np.repeat(size, size))
        out[some, 2] = np.maximum.reduceat(passage, first[:-1][some])
    return out


_received: dict[int, object] = {}


def _sent(spark: SparkSession, value: object) -> Broadcast:
    """A model or vocabulary, of the size of the sample's vocabulary, for all workers."""
    return spark.sparkContext.broadcast(zlib.compress(pickle.dumps(value), 1))


def _unpacked(sent: Broadcast):
    """The worker's copy of what it got last."""
    name = zlib.crc32(sent.value)
    if name not in _received:
        _received.clear()
        _received[name] = pickle.loads(zlib.decompress(sent.value))
    return _received[name]


def _scored(rows: DataFrame, model: Model, *wanted: str, keep_text: bool = False) -> DataFrame:
    """Rows (text, ...) with the wanted columns, features or a score, in place of the text or, with ``keep_text``, behind all."""
    sent = _sent(rows.sparkSession, model)
    schema = StructType([*(f for f in rows.schema if keep_text or f.name != "text"), *(StructField(x, DoubleType()) for x in wanted)])
    columns = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpacked(sent)
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for i, j, words, first, stems in _words(batch, at, SHORT_STEP):
                features = _features(model, words, first, stems)
                if len(model.weights):
                    new = [pa.array(1 / (1 + np.exp(-np.clip(features @ model.weights, -500, 500))))]
                else:
                    new = [pa.array(features[:, k]) for k in (1, 2)]
                kept = [batch.column(k).slice(i, j - i) for k in range(len(names)) if keep_text or k != at]
                yield pa.RecordBatch.from_arrays([*kept, *new], columns)

    return rows.mapInArrow(work, schema)


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's steps."""
    w = np.zeros(features.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (features.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weights * (labels - p)) - ridge @ w
        curve = (features * (weights * p * (1 - p))[:, None]).T @ features + ridge
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of a key as text is divisible by ``folds``."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Models and score from labelled rows that are not held out.

    ``labels`` has doc_id and toxic (1 or 0; other values and nulls are no labels). Of each class
    a sample drawn by a hash of doc_id, of about ``toxic_rows`` and ``ordinary_rows`` at most, is
    used (its ids and vocabulary are broadcast); shared counts come from all documents. Every fifth of a
    class's rows with a text fits the score, the first one always; the only row of a class serves the models too. With
    one class only, or no labels, every score is that class's share (0 without labels).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {1: min(1.0, toxic_rows / max(1, counts.get(1, 0))), 0: min(1.0, ordinary_rows / max(1, counts.get(0, 0)))}
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / float(1 << 53)
    drawn = known.where(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")
    sample, path = stored(sample, "toxicity-sample")
    # ids of the sample only, which is bounded
    of_class = Window.partitionBy("toxic")
    folds = sample.select("doc_id", "toxic").distinct().select(
        "doc_id", F.row_number().over(of_class.orderBy(F.xxhash64("doc_id", F.lit("fold")), "doc_id")).alias("turn"),
        F.count(F.lit(1)).over(of_class).alias("size")).select(
        "doc_id", (F.col("turn") % SCORE_FOLDS == 1).alias("scores"), ((F.col("turn") % SCORE_FOLDS != 1) | (F.col("size") == 1)).alias("models"))
    sample = sample.join(F.broadcast(folds), "doc_id").select("text", "toxic", "scores", "models")
    model = fit_models(documents, sample.where("models").select("text", "toxic"))
    rows = _scored(sample.where("scores").select("text", "toxic"), model, "whole", "passage").toArrow()  # bounded by the sample
    drop_stored(documents.sparkSession, path)
    x = np.column_stack([np.ones(len(rows)), rows["whole"].to_numpy(), rows["passage"].to_numpy()])
    y = rows["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return model._replace(weights=np.array([np.log(edge / (1 - edge)), 0.0, 0.0]))
    return model._replace(weights=logistic(x, y, np.where(y == 1, 1 / rate[1], 1 / rate[0])))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row.

    Null, empty and wordless texts have the score of a text without evidence. Equal texts score alike; rows that
    repeat a doc_id, or lack one, are scored each; a null doc_id is held out as the empty text is by its crc32.
    Texts are read whole in steps of bounded size, a longer text in one. Other columns are not read.
    An empty table gives no rows.
    """
    model = fit(documents, labels)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns whatever their names, whose score is below 0.5; see ``toxicity`` for nulls and empty texts."""
    model = fit(documents, labels)
    columns, texts = documents.columns, [k for k, f in enumerate(documents.schema) if f.name == "text" and f.dataType == StringType()]
    # by place, so that names may hold or repeat anything; a text is sent to the workers once
    names = [f"column{k}" for k in range(len(columns))]
    if len(texts) == 1:
        names[texts[0]] = "text"
        rows = documents.toDF(*names)
    else:  # of another type, or of a name in other letters
        rows = documents.select("*", F.col("text").cast("string").alias("text")).toDF(*names, "text")
    return _scored(rows, model, "score", keep_text=len(texts) == 1).where("score < 0.5").select(
        *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
