"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Texts with equal shingle sets form one class, named by its smallest doc_id. Classes that share a
band of their signature are candidates. A candidate's signatures are compared batch by batch; it
is dropped as soon as the posterior probability of a similarity at or above the threshold falls
below the chosen miss probability. Survivors are compared on their full shingle sets.

A band's bucket is not expanded into all pairs. Shingles that no other candidate has bound the
similarity of a class from above: most edited copies of one text can be linked with nothing and
drop out. The others are compared with their bucket's hub, the member with the fewest shingles of
its own; two members that it links are in one component and need no other comparison. The other
pairs of a bucket are compared as well, unless the shingles that each shares with the hub, and its
others but its own ones, are too few for a link: so no component is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.common import mix, shingles, slices, stored
from tracehold.llm.components import components
from tracehold.session import materialize, new_folder, scratch

BANDS, ROWS = 32, 6
WORDS = 5
#: Probability of losing a candidate at or above the threshold by the posterior bounds of all looks together.
MISS = 1e-7
#: Signature places that are compared before the next decision.
BATCH = 32
SIGNATURE = "doc_id long, text_key long, n_shingles long, set1 long, set2 long, bands array<long>, signature binary"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds, mix(seeds) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima of hashed shingles for each non-empty set, as 32-bit numbers (sets x n)."""
    every = np.concatenate(sets)
    starts = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.empty((n, len(sets)), dtype=np.uint32)
    work = np.empty_like(every)
    for k, (seed, factor) in enumerate(zip(*_seeds(n), strict=True)):
        np.bitwise_xor(every, seed, out=work)
        np.multiply(work, factor, out=work)
        out[k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out.T.copy()


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def sign(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit digest of the set, band keys, and 8 bits of each minimum."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                sets = list(shingles(data, offsets, words))
                some = [s for s in sets if len(s)]
                full = np.array([len(s) > 0 for s in sets])
                digests = np.zeros((2, j - i), dtype=np.uint64)
                keys, signs = [None] * (j - i), [None] * (j - i)
                if some:
                    found = signatures(some, bands * rows)
                    for d, factor in enumerate((0x9FB21C651E98DF25, 0xD1342543DE82EF95)):
                        digests[d, full] = [mix(np.array([np.sum(
                            mix(s * np.uint64(factor)), dtype=np.uint64) + np.uint64(len(s))]))[0] for s in some]
                    band = np.zeros((len(some), bands), dtype=np.uint64)
                    parts = found.reshape(len(some), bands, rows).astype(np.uint64)
                    for r in range(rows):
                        band = mix(band ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    band = mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    for at, b, f in zip(np.flatnonzero(full).tolist(), band, found.astype(np.uint8), strict=True):
                        keys[at], signs[at] = b, f.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                    pa.array(keys, type=pa.list_(pa.int64())), pa.array(signs, type=pa.binary()),
                ], [x.split()[0] for x in SIGNATURE.split(", ")])

    return _rows(documents).mapInArrow(work, SIGNATURE)


@lru_cache
def least_matches(n: int, similarity: float, miss: float, looks: int = 1) -> int:
    """The fewest of n equal signature places that keep a candidate at one of some looks.

    With a uniform prior the similarity given m of n is Beta(m + 1, n - m + 1); its tail at or above the
    threshold is P(Binomial(n + 1, s) <= m), which is at most P(Binomial(n, s) <= m), the chance that a pair at
    the threshold shows so few. A candidate goes where the latter is below ``miss / looks``: so is the
    posterior tail then, and over all looks a pair at or above the threshold is lost with a probability of at most
    ``miss``. Chance equality of 8-bit places only adds matches, so it never drops a candidate.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1 - m)
                          + m * math.log(similarity) + (n - m) * math.log1p(-similarity))
        if total >= miss / looks:
            return m
    return n


def surviving(pairs: DataFrame, percent: int, miss: float = MISS, batch: int = BATCH) -> DataFrame:
    """The pairs (a, b, sign_a, sign_b) that no batch of signature places rules out."""
    similarity = percent / 100

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1) for c in (2, 3))
            alive, matches = np.arange(rows.num_rows), np.zeros(rows.num_rows, dtype=np.int64)
            looks = -(-left.shape[1] // batch)
            for at in range(0, left.shape[1], batch):
                matches[alive] += (left[alive, at:at + batch] == right[alive, at:at + batch]).sum(axis=1)
                n = min(at + batch, left.shape[1])
                alive = alive[matches[alive] >= least_matches(n, similarity, miss, looks)]
            yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(alive)) for c in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(work, "a long, b long")


def common_shingles(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, n_a, n_b, common) of pairs (a, b): sizes of their full shingle sets and of the intersection.

    ``texts`` has id and text.
    """
    schema = "a long, b long, n_a long, n_b long, common long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for rows in batches:
            for i in range(0, rows.num_rows, 64):
                part = rows.slice(i, 64)
                sets, sizes = [], []
                for ids, column in ((part.column(0), part.column(2)), (part.column(1), part.column(3))):
                    ids = ids.to_pylist()
                    first = {x: k for k, x in reversed(list(enumerate(ids))) if x not in known}
                    some = column.take(pa.array(list(first.values()), type=pa.int64()))
                    new = list(first)
                    for a, b, data, offsets in slices(some):
                        known.update(zip(new[a:b], shingles(data, offsets, words), strict=True))
                    sets.append([known[x] for x in ids])
                    sizes.append(pa.array([len(x) for x in sets[-1]], type=pa.int64()))
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *sizes, pa.array(common, type=pa.int64())], ["a", "b", "n_a", "n_b", "common"])
                if len(known) > 256:
                    known = {}

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(work, schema)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The linked ones of candidate pairs of classes (a, b, sign_a, sign_b), stored."""
    alive, _ = stored(surviving(pairs, percent), "candidates")
    linked = (F.col("common") > 0) & (F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent)
    return stored(common_shingles(alive, texts).where(linked).select("a", "b"), "links")[0]


def own_shingles(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, own): shingles of each of some texts (id, text) that no other of them has; none: no row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offsets in slices(batch.column(1)):
                sets = list(shingles(data, offsets, words))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[i:i + len(sets)], [len(s) for s in sets])),
                    pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    each = texts.select("id", "text").mapInArrow(work, "id long, shingle long")
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).where("_n = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _may_link(percent: int, *names: str):
    """Whether sizes n and own shingles leave room for a link: own ones are in no intersection."""
    x, y = names
    common = F.least(F.col(f"{x}n") - F.col(f"{x}own"), F.col(f"{y}n") - F.col(f"{y}own"))
    return common * 100 >= (F.col(f"{x}n") + F.col(f"{y}n") - common) * percent


def _may_link_any(percent: int, name: str):
    """Whether a link with a text of any size is possible: at best one that holds the shared shingles alone."""
    return (F.col(f"{name}n") - F.col(f"{name}own")) * 100 >= F.col(f"{name}n") * percent


def near_duplicates(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked doc_id) and kept of every row.

    Links join rows whose sets of 5-word shingles have ``100 * intersection >= percent * union``;
    equal sets are links too, so repeated rows are. Rows without words, null texts included, are
    linked with nothing. Rows without a doc_id take part in no link: their component is NULL and
    they are kept. Other columns are not read.
    """
    return classified(documents, percent, bands, rows).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(documents: DataFrame, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """The documents, all columns, with one of each group of near-duplicates: the smallest doc_id.

    Of rows that repeat a doc_id in a group one is kept. Rows without a doc_id are kept.
    """
    chosen = classified(documents, percent, bands, rows).where("first").select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    key = F.xxhash64(F.col("text").cast("string"))
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
                             F.col("doc_id").cast("long").alias("_doc"), key.alias("_key"))
    named = boxed.where(F.col("_doc").isNotNull()).join(chosen, ["_doc", "_key"])
    again = F.row_number().over(Window.partitionBy("_doc", "_key").orderBy(F.lit(0)))
    once = named.withColumn("_n", again).where((F.col("_n") == 1) | F.col("_row.text").isNull() | ~F.col("_row.text").rlike("[^ \\t-\\r]"))
    return once.select("_row.*").unionByName(boxed.where(F.col("_doc").isNull()).select("_row.*"))


def classified(documents: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and whether a row is the first of its component."""
    spark = documents.sparkSession
    signed, _ = stored(sign(documents, bands, rows), "signatures")
    in_class = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    path = new_folder(spark, "named-classes")
    with scratch(spark):
        named = materialize(_named_classes(signed.where(in_class), documents, percent), "named-classes", path)
    columns = ["doc_id", "text_key", "n_shingles"]
    return signed.where(in_class).select("doc_id", "text_key", *_EQUAL).join(named, _EQUAL).select(
        *columns, F.col("lowest.doc_id").alias("component_id"),
        (F.struct("doc_id", "text_key") == F.col("lowest")).alias("first")).unionByName(
        signed.where(~in_class).select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


#: Rows with these in common have equal shingle sets.
_EQUAL = ["set1", "set2", "n_shingles"]


def _named_classes(some: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """set1, set2, n_shingles and lowest (the first doc_id and text_key of the component) of every class."""
    classes, _ = stored(some.groupBy(*_EQUAL).agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared, _ = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band"), "bands")
    found, _ = stored(members.join(shared, "band"), "buckets")
    some_classes = found.select("id").distinct().join(classes.select("id", "first.doc_id", "first.text_key"), "id")
    texts, _ = stored(some_classes.join(_rows(documents), ["doc_id", "text_key"]).dropDuplicates(["id"]).select("id", "text"), "candidate-texts")
    own, _ = stored(own_shingles(texts), "own-shingles")
    held, _ = stored(found.join(own, "id", "left").na.fill(0, ["own"]), "held")

    # first every member with its bucket's hub, the one with the fewest shingles of its own
    hubs = held.groupBy("band").agg(F.min(F.struct("own", "id", "n")).alias("_h")).select(
        "band", F.col("_h.id").alias("h_id"), F.col("_h.n").alias("h_n"), F.col("_h.own").alias("h_own"))
    hubs, _ = stored(hubs, "hubs")
    seen = held.withColumnsRenamed({"id": "m_id", "n": "m_n", "own": "m_own"}).join(hubs, "band").where("m_id != h_id").withColumns(
        {"a": F.least("m_id", "h_id"), "b": F.greatest("m_id", "h_id")})
    seen, _ = stored(seen, "members")
    first = seen.where(_may_link(percent, "m_", "h_")).select("a", "b").distinct()
    for side in "ab":
        first = first.join(classes.select(F.col("id").alias(side), F.col("signature").alias(f"sign_{side}")), side)
    links = _verified(first, texts, percent)

    # members that are not both linked to the hub are compared, where a link is possible
    able = seen.where(_may_link_any(percent, "m_")).join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select(
        "band", "a", "b", "m_id", "m_n", "m_own", F.coalesce("linked", F.lit(False)).alias("m_linked"))
    able, _ = stored(able, "able")
    split = able.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("m_linked")).alias("_k")).where("_n > 1 AND _k > 0")
    rest, _ = stored(able.join(stored(split.select("band"), "split-bands")[0], "band"), "split-members")
    with_hub, _ = stored(common_shingles(rest.select("a", "b").distinct(), texts).select("a", "b", "common"), "hub-shingles")
    rest = rest.join(with_hub, ["a", "b"]).join(classes.select(
        F.col("id").alias("m_id"), F.col("bands").alias("m_bands"), F.col("signature").alias("m_sign")), "m_id")
    rest, _ = stored(rest.select(
        "band", "m_id", "m_n", "m_linked", "m_bands", "m_sign", F.col("common").alias("m_hub"),
        (F.col("m_n") - F.col("common") - F.col("m_own")).alias("m_rest")), "split-buckets")
    x, y = (rest.withColumnsRenamed({c: c.replace("m_", f"{p}_") for c in rest.columns if c != "band"}) for p in "xy")
    first_shared = F.element_at(F.array_intersect("x_bands", "y_bands"), 1)  # a pair counts in one band alone
    # in common are at most the fewer shingles of the hub and the fewer of the others but own ones
    most = F.least("x_hub", "y_hub") + F.least("x_rest", "y_rest")
    more = x.join(y, "band").where(
        (F.col("x_id") < F.col("y_id")) & ~(F.col("x_linked") & F.col("y_linked"))
        & (most * 100 >= (F.col("x_n") + F.col("y_n") - most) * percent) & (first_shared == F.col("band")))
    more_links = _verified(more.select(
        F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.col("x_sign").alias("sign_a"), F.col("y_sign").alias("sign_b")), texts, percent)

    final = components(links.unionByName(more_links))
    named = classes.join(final, classes["id"] == final["node"], "left").select(
        *_EQUAL, "first", F.coalesce("component", "id").alias("c"))
    lowest = named.groupBy("c").agg(F.min("first").alias("lowest"))
    return named.join(lowest, "c").select(*_EQUAL, "lowest")
