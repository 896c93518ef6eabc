"""Operators on documents against brute force, on the smallest tables and on awkward rows."""

from collections import Counter, defaultdict
from fractions import Fraction
import hashlib
from math import comb
from pathlib import Path
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import data
from tokenizers import Tokenizer

from tracehold.llm import minhash, orc_tokens, packing, pii, queries, sharding, suffix, tiling, tokens, toxicity
from tracehold.llm.components import components
from tracehold.llm.common import MARKS, distinct, sequence_hashes, word_hashes


@pytest.fixture(scope="module")
def strange(spark):
    return data.documents(spark, data.awkward())


@pytest.fixture(scope="module")
def empty(strange):
    return strange.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


# sharding

def test_shards_follow_the_key_law(spark, small, strange):
    for frame, rows in ((queries.op2_sharding(spark, small), data.texts(small)),
                        (sharding.shard_documents(strange, sharding.topology(16), sharding.grown(sharding.topology(16))), data.awkward())):
        got = frame.collect()
        expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
        assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_moves_rows_into_changed_subtrees_alone(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    old = sharding.topology(16)
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in old]
    rows = keys.select(sharding.shard_of(F.col("key"), old).alias("a"), sharding.shard_of(F.col("key"), heavier).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(old[b].region == "region1" for _, b in moved)
    counts = Counter(r.a for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.4 * min(counts.values())


def test_a_shard_without_weight_gets_nothing(spark):
    leaves = [sharding.Leaf("r", "k", 0, 0.0), sharding.Leaf("r", "k", 1)]
    assert {r.s for r in spark.range(50).select(sharding.shard_of(F.col("id").cast("string"), leaves).alias("s")).collect()} == {1}
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), leaves[:1])


def test_no_rows_no_shards(empty):
    assert sharding.shard_documents(empty, sharding.topology(3)).count() == 0


# suffix index

def plain_spans(bodies, window):
    seen = Counter(b[i:i + window] for b in bodies for i in range(len(b) - window + 1))
    return [suffix.merge((i, i + window) for i in range(len(b) - window + 1) if seen[b[i:i + window]] > 1) for b in bodies]


def test_run_index_finds_every_repeat():
    rng = random.Random(1)
    for _ in range(200):
        window, base = rng.choice([3, 5, 9]), bytes(rng.choice(b"ab") for _ in range(60))
        parts = list(dict.fromkeys(base[(a := rng.randrange(50)):a + rng.randrange(3, 25)] for _ in range(rng.randrange(1, 8))))
        assert [suffix.merge(x) for x in suffix.repeated_spans(parts, window)] == plain_spans(parts, window)


def test_runs_of_a_repetitive_index_are_few():
    text = bytes(random.Random(2).choice(b"abcdefgh") for _ in range(500))
    index = suffix.RunIndex([text + bytes([i]) for i in range(40)])
    assert index.size == 40 * 501 and index.runs < index.size / 8


def check_removed(frame, rows, window):
    expected = Counter()
    for (i, t), spans in zip(rows, plain_spans([(t or "").encode() for _, t in rows], window), strict=True):
        body, kept, at = (t or "").encode(), b"", 0
        for a, b in spans:
            kept, at = kept + body[at:a], b
        kept += body[at:]
        expected[(i, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in frame.collect()) == expected


def test_marks_of_repeated_rows_do_not_add_up(spark):
    """Rows that repeat a doc_id and text are each marked once, however many there are."""
    rng = random.Random(16)
    body = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(400))
    counts = []
    for copies in (5, 40):
        rows = [(7, body)] * copies + [(None, body[::-1])] * copies + [(8, body[:900] + "!")]
        found = suffix.repeated_strings(data.documents(spark, rows))
        counts.append(max(len(r.spans) for r in found.select("spans").collect()))
        check_removed(suffix.removed_digest(suffix.repeated_strings(data.documents(spark, rows))), rows, 200)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("wide", [200, 1])
def test_removed_strings(spark, small, strange, monkeypatch, wide):
    monkeypatch.setattr(suffix, "WIDE_GRAM", wide)
    check_removed(queries.op3_suffix_dedup(spark, small), data.texts(small), 200)
    rows = [(i, t if t is None or len(t) < 50_000 else t[:30_000]) for i, t in data.awkward()]
    check_removed(suffix.removed_digest(suffix.repeated_strings(data.documents(spark, rows), 40, 16)), rows, 40)


@pytest.mark.parametrize("many", [30, 1])
def test_a_passage_of_many_texts_is_compared_once(spark, monkeypatch, many):
    rng, rows_of_a_shard, plain = random.Random(14), [], suffix._indexed
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(500)
    rows = [(i, text(150) + (passage if i % 3 else passage[:250] + rng.choice("uvw") + passage[250:]) + text(150)) for i in range(90)]

    def indexed(filed, window):
        rows_of_a_shard.extend(r["count"] for r in filed.groupBy("shard").count().collect())
        return plain(filed, window)

    monkeypatch.setattr(suffix, "WIDE_GRAM", 20)
    monkeypatch.setattr(suffix, "WIDE_CORE", many, raising=False)
    monkeypatch.setattr(suffix, "_indexed", indexed)
    check_removed(suffix.removed_digest(suffix.repeated_strings(data.documents(spark, rows))), rows, 200)
    assert max(rows_of_a_shard) <= 30


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix, "STEP", 1000)
    rng = random.Random(3)
    block = "".join(rng.choice("abcdef") for _ in range(900))
    rows = [(1, "".join(rng.choice("abcdef") for _ in range(5000)) + block + "z" * 300), (2, block[50:]), (3, "y" + block)]
    got = [suffix.segments(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), 200, 64) for _, t in rows]
    assert all(len(x[0]) for x in got)
    check_removed(suffix.removed_digest(suffix.repeated_strings(data.documents(spark, rows))), rows, 200)


def test_no_rows_nothing_removed(empty):
    assert suffix.removed_digest(suffix.repeated_strings(empty)).count() == 0


# toxicity

def test_toxicity_learns_without_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in data.table_rows(folder, "labels")}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    positive, negative = [s for s, y in held if y], [s for s, y in held if not y]
    better = np.mean([[p > n for n in negative] for p in positive])
    assert better > 0.75


def test_toxicity_catches_planted_words_and_spares_the_rest(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["snarkle", "grobbit", "snarkling"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "a snarkle b grobbit c"), (1002, "Snarkle, grobbit!"), (1002, "ab cd")]
    labels += [(5, None), (None, 1), (7, 9)]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(data.documents(spark, rows), frame).collect()
    assert len(got) == len(rows)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 600)
    assert right >= 594
    assert all(r.score < 0.5 for r in got if r.doc_id in (1000, 1001))
    kept = toxicity.accepted(data.documents(spark, rows), frame)
    assert kept.columns == data.documents(spark, []).columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def word_name(word):
    (hashed,) = word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), MARKS)[0]
    return hashed


def test_shared_counts_do_not_saturate(spark):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = [(i, f"{w} hub {w} HUB, {w} rare{i % 7}") for i, w in enumerate(words)] + [(None, None), (-1, ""), (-2, "hub")]
    before = defaultdict(set)
    for _, text in rows:
        own = words_of(text)
        for left, right in zip(own, own[1:], strict=False):
            before[right].add(left)
    sampled = sorted({"hub", "absent", *words[::3]})
    names = toxicity.Names(np.array([word_name(w) for w in sampled]))
    got = {r.word: r.contexts for r in toxicity.shared_counts(data.documents(spark, rows), names).collect()}
    place = dict(zip(sampled, names.places(np.array([word_name(w) for w in sampled])).tolist(), strict=True))
    expected = {place[w]: len(before[w]) for w in sampled if before[w]}
    expected[names.size] = sum(len(lefts) for w, lefts in before.items() if w not in place)
    assert got == expected
    assert got[place["hub"]] > 2900


def test_gaps_come_back():
    for gaps in ([], [0], [1 << 32], [5, (1 << 32) - 1, 1 << 32, (1 << 50) + 7, 0, 3], list(range(1000))):
        blob = toxicity._packed_gaps(np.array(gaps, dtype=np.int64))
        assert toxicity._gaps(blob).tolist() == gaps
        assert len(blob) == 4 + 4 * len(gaps) + 8 * sum(g >= 1 << 32 for g in gaps)


def test_distinct_numbers_take_little_memory():
    rng = np.random.default_rng(8)
    for dtype in (np.int64, np.uint64):
        some = [rng.integers(0, 500, n).astype(dtype) for n in (0, 3000, 1, 700)]
        assert distinct(*some).tolist() == sorted({x for a in some for x in a.tolist()})
        assert distinct(some[0]).dtype == dtype and distinct(*some).dtype == dtype
    kept = some[1].copy()
    distinct(some[1])
    assert (some[1] == kept).all()
    # a fresh process, whose peak is that of this step; a hash set of so many numbers takes more than 100 MB
    code = """
import re, sys
import numpy as np
from tracehold.llm.common import distinct
held = [np.random.default_rng(i).integers(0, 1 << 62, 1 << 18) for i in range(8)]
def peak(): return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1])
before = peak()
assert len(distinct(*held)) > 2_000_000
print((peak() - before) // 1024)
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(ran.stdout) < 48  # MB; the numbers are 16, and are there twice


def test_accepted_sends_each_text_once(spark, monkeypatch):
    sent, scored = [], toxicity._scored
    monkeypatch.setattr(toxicity, "_scored", lambda rows, *a, **b: (sent.append(rows), scored(rows, *a, **b))[1])
    rows = [(i, f"only text number {i} here") for i in range(40)]
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.accepted(data.documents(spark, rows), labels)
    assert all(str(r.asDict(recursive=True)).count("only text") == 1 for r in sent[-1].collect())
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, data.documents(spark, rows).collect()))
    # any names and types, also of the text; the order and types of the columns stay
    named = data.documents(spark, rows).selectExpr(
        "doc_id", "1 as score", "2 as column0", "array(named_struct('text', 3)) as `a.b`", "text", "4 as _row", "5 as `a.b`")
    kept = toxicity.accepted(named, labels)
    assert kept.dtypes == named.dtypes
    assert sorted(map(str, kept.collect())) == sorted(map(str, named.collect()))
    for coded in (named.selectExpr("doc_id", "cast(text as binary) as text"), named.selectExpr("doc_id", "text as TEXT", "4 as column1")):
        kept = toxicity.accepted(coded, labels)
        assert kept.dtypes == coded.dtypes
        assert sorted(map(str, kept.collect())) == sorted(map(str, coded.collect()))


def test_names_find_every_known_hash_and_no_other():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50_000):
        known = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        if n == 2:
            known = np.array([0, (1 << 64) - 1], dtype=np.uint64)
        if n == 50_000:  # neighbours share a slot
            known = np.unique(np.append(known, np.arange(40, dtype=np.uint64) + known[100]))
        names = toxicity.Names(known)
        assert (names.places(known) == np.arange(len(known))).all()
        others = np.setdiff1d(rng.integers(0, 1 << 64, 1000, dtype=np.uint64), known)
        assert (names.places(others) == len(known)).all()


def kneser_ney(corpus, sample, texts):
    """Log-likelihood ratios per word, of whole texts and of their most toxic two words, by dictionaries of strings."""
    shared_before = defaultdict(set)
    for text in corpus:
        own = words_of(text)
        for left, right in zip(own, own[1:], strict=False):
            shared_before[right].add(left)
    vocabulary = {w for text, _ in sample for w in words_of(text)}
    total = sum(len(x) for x in shared_before.values()) + len(vocabulary) + 1
    word, stem, pair = ([defaultdict(set), defaultdict(set)] for _ in range(3))
    for text, toxic in sample:
        own = words_of(text)
        for k, w in enumerate(own):
            left = own[k - 1] if k else None
            word[1 - toxic][w].add(left)
            stem[1 - toxic][w.encode()[:toxicity.STEM]].add(left)
            if k:
                pair[1 - toxic][left, w].add(own[k - 2] if k > 1 else None)

    def discounted(counts):
        n = max(1, sum(counts.values()))
        shares = {k: max(0, x - toxicity.DISCOUNT) / n for k, x in counts.items()}
        return shares, 1 - sum(shares.values())

    def first_words(c):
        seen, cut = defaultdict(float), defaultdict(float)
        for (left, _), x in pair[c].items():
            seen[left] += len(x)
            cut[left] += min(len(x), toxicity.DISCOUNT)
        return {left: (n, cut[left]) for left, n in seen.items() if cut[left] < n}

    words = [discounted({w: len(x) for w, x in word[c].items()}) for c in (0, 1)]
    stems = [discounted({w: len(x) for w, x in stem[c].items()}) for c in (0, 1)]
    heads = [first_words(c) for c in (0, 1)]
    of_all = {k: sum(len(stem[c].get(k, ())) / max(1, sum(map(len, stem[c].values()))) for c in (0, 1)) / 2 for k in {*stem[0], *stem[1]}}

    def likelihood(c, left, w):
        key = w.encode()[:toxicity.STEM]
        factor = (stems[c][0].get(key, 0) + stems[c][1] * of_all[key]) / of_all[key] if key in of_all else 1
        known = len(shared_before.get(w, ())) if w in vocabulary else 0
        p = words[c][0].get(w, 0) + words[c][1] * factor * (1 + known) / total
        if left in heads[c]:
            seen, cut = heads[c][left]
            p = (max(0, len(pair[c].get((left, w), ())) - toxicity.DISCOUNT) + cut * p) / seen
        return p

    out = []
    for text in texts:
        own = words_of(text)
        ratios = [np.log(likelihood(0, own[k - 1] if k else None, w) / likelihood(1, own[k - 1] if k else None, w)) for k, w in enumerate(own)]
        passages = [sum(ratios[k:k + toxicity.PASSAGE]) / min(toxicity.PASSAGE, len(own)) for k in range(len(own))]
        out.append((np.mean(ratios), max(passages)) if own else (0.0, 0.0))
    return out


def test_models_equal_kneser_ney_over_strings(spark):
    rng = random.Random(23)
    words = ["ab", "abcd", "abcdef", "é", "中文x", "b", "bc", "snarkle", "snarking", "grob"]
    texts = [" ".join(rng.choice(words[:7 + 3 * (i % 3 == 0)]) for _ in range(rng.randrange(1, 60))) for i in range(150)]
    sample = [(t, int(i % 3 == 0)) for i, t in enumerate(texts)]
    others = ["new words, AB new snarklish", None, "", "  ", "snarkle grob snarkle grob", "unheard", "ab unheard grob", texts[0]]
    rows = [(i, t) for i, t in enumerate(texts + others)]
    frame = spark.createDataFrame(sample, "text string, toxic int")
    model = toxicity.fit_models(data.documents(spark, rows), frame)
    assert model.pair.any() and model.seen.any()
    asked = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: (r.whole, r.passage) for r in toxicity._scored(asked, model, "whole", "passage").collect()}
    expected = kneser_ney([t for _, t in rows], sample, [t for _, t in rows])
    assert len(got) == len(rows)
    for i, pair in enumerate(expected):
        assert got[i] == pytest.approx(pair, rel=1e-4, abs=1e-5), rows[i]


def test_both_classes_fit_the_score_when_one_is_rare(spark):
    rows = [(i, f"plain words number{i % 7} and more") for i in range(300)]
    toxic = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:12]
    for count in (1, 2, 12):
        texts = [(i, "snarkle grobbit snarkle" if i in toxic[:count] else t) for i, t in rows]
        labels = spark.createDataFrame([(i, int(i in toxic[:count])) for i, _ in rows], "doc_id long, toxic int")
        scores = {r.doc_id: r.score for r in toxicity.toxicity(data.documents(spark, texts), labels).collect()}
        assert min(scores[i] for i in toxic[:count]) > max(s for i, s in scores.items() if i not in toxic[:count])


def test_toxicity_without_labels_or_classes(spark, strange, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(strange, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(strange, one).collect()} == {1}


# tokens

def test_encoder_equals_the_library(tokenizer):
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    rng, letters = random.Random(6), "abAB,.!?'éÉüßÀµªº²½0 19\n\t\xa0\x85 Σσςİ́中文<|>-_$€\x1c\x00ñ×÷"
    for k in range(150):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(20)]
        texts += ["a<|endoftext|>b it's, c.\nd."] * (k % 3 == 0) + ["x,", "", None, "é,"]
        for i, j, ids, counts in encoder.encode_column(pa.array(texts, pa.string())):
            at = np.append(0, np.cumsum(counts))
            for n, text in enumerate(texts[i:j]):
                assert ids[at[n]:at[n + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_forgets_and_goes_on(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 5)
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    for text in ("one two three four", "five six seven", "one nine, ten."):
        (found,) = encoder.encode_column(pa.array([text]))
        assert found[2].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_token_files(spark, documents, rows, tokenizer, path):
    orc_tokens.write_tokens(documents, path, queries.tokenizer_path())
    got = orc_tokens.token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    expected = Counter((i, len(x := ids_of(tokenizer, t, 1)), zlib.crc32(x.tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    stored = {(r.doc_id, tuple(r.ids)) for r in orc_tokens.read_tokens(spark, path).collect()}
    assert stored == {(i, tuple(ids_of(tokenizer, t, 1).tolist())) for i, t in rows}


def test_token_files_round_trip(spark, small, strange, empty, tokenizer, tmp_path):
    check_token_files(spark, spark.read.parquet(f"{small}/documents.parquet"), data.texts(small), tokenizer, f"{tmp_path}/a")
    check_token_files(spark, strange, data.awkward(), tokenizer, f"{tmp_path}/b")
    orc_tokens.write_tokens(empty, f"{tmp_path}/c", queries.tokenizer_path())
    assert orc_tokens.token_index(spark, f"{tmp_path}/c").count() == 0


# packing

def test_best_fit_is_the_tightest_bin():
    rng = random.Random(7)
    for _ in range(50):
        capacity = rng.choice([1, 7, 64, 100])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))), reverse=True)
        room, bins = [], []
        for length in lengths:
            fits = [r for r in room if r >= length]
            if not fits:
                room.append(capacity)
                fits = [capacity]
            tight = min(fits)
            bins.append(tight)
            room[room.index(tight)] -= length
        got, offsets = packing.best_fit(lengths, capacity)
        assert [capacity - o for o in offsets] == bins
        assert len(set(got)) == len(room)


def check_packed(frame, rows, tokenizer, capacity):
    got, expected, filled = frame.collect(), Counter(), defaultdict(list)
    for i, t in rows:
        ids = ids_of(tokenizer, t, 0)
        for p, a in enumerate(range(0, len(ids), capacity)):
            piece = ids[a:a + capacity]
            expected[(i, p, a, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(filled) <= 1.02 * -(-total // capacity) + 1


def test_packed_documents(spark, small, strange, empty, tokenizer):
    check_packed(queries.op6_best_fit_packing(spark, small), data.texts(small), tokenizer, 2048)
    check_packed(packing.pack_documents(strange, queries.tokenizer_path(), 64), data.awkward(), tokenizer, 64)
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(i, "word " * (i % 9) + "end") for i in range(60)]
    pieces, _ = packing.token_pieces(data.documents(spark, rows), queries.tokenizer_path(), 16)
    sequences = packing.sequences(packing.pack(pieces, 16), pieces).collect()
    assert Counter(x for r in sequences for x in r.ids) == Counter(x for _, t in rows for x in ids_of(tokenizer, t, 0).tolist())
    assert all(len(r.ids) <= 16 for r in sequences)


# personal data

PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and pii.luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
)


def plain_base(text):
    return [(k, m.start(), m.end()) for k, (pattern, good) in enumerate(PATTERNS) for m in re.finditer(pattern, text)
            if good(m.group(), re.sub("[^0-9]", "", m.group()))]


def test_base_spans_equal_the_patterns():
    rng, kinds = random.Random(8), ["ab@.@.-a1", "0123456789. -+()", "1.2.", "+1 2(3)4-5", "@a.b@c.d ", "4111 1111-1111 1111 "]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("card 4111 1111 1111 1111 x") == [(2, 5, 24)]


@pytest.mark.parametrize("which", ["small", "strange"])
def test_personal_data(spark, small, strange, which):
    rows = data.texts(small) if which == "small" else data.awkward()
    frame = queries.op7_personal_data(spark, small) if which == "small" else pii.personal_data(strange)
    got, expected = frame.collect(), Counter()
    for i, t in rows:
        base = sorted(plain_base(t or ""))
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        counts = [sum(x[0] == k for x in base) for k in range(4)]
        expected[(i, *counts, hashlib.sha256(told.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    for r in got:
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_labelers_agreeing_win_over_one_that_errs():
    rng = np.random.default_rng(9)
    truth = rng.random(5000) < 0.4
    rates = (0.95, 0.9, 0.85, 0.5)
    votes = np.stack([np.where(rng.random(5000) < r, truth, ~truth).astype(int) for r in rates], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 2
    codes, where, counts = np.unique(votes @ [27, 9, 3, 1], return_inverse=True, return_counts=True)
    patterns = (codes[:, None] // 3 ** np.arange(3, -1, -1)) % 3
    share, learned = pii.reliabilities(patterns, counts)
    assert ((share[where] >= 0.5) == truth).mean() > 0.93
    right = learned[1, :, 1] / (learned[1, :, 0] + learned[1, :, 1])
    assert right[0] > 0.9 and right[2] > 0.8 and right[3] < 0.6


def test_overlapping_spans_are_replaced_whole():
    text = "at 1.2.3.4 111 1111 1111 1111 now"
    spans = pii.base_spans(text)
    assert {k for k, _, _ in spans} == {1, 2} and len(spans) == 2
    assert pii.replaced(text, spans) == "at <ip><card> now"
    assert pii.replaced("abcdef", [(0, 1, 5), (1, 2, 4), (2, 5, 6)]) == "a<email><card>"
    assert pii.replaced("abc", []) == "abc"


def test_overlaps_are_decided_among_accepted_candidates():
    text = "order/555-123-4567 done"
    kinds = sorted(k for k, _, _ in pii.further_spans(text, []))
    assert kinds == [4, 5]
    found = [pii.judged(text, *x)._asdict() for x in pii.further_spans(text, [])]
    weights = np.zeros(len(pii._encoded(np.zeros(1, dtype=int), np.zeros(1, dtype=int))[0]))
    for refused, kept in ((4, [5]), (5, [4]), (None, [4])):
        now = weights.copy()
        if refused is not None:
            now[1 + refused] = -1.0
        assert [k for k, _, _ in pii._decided(found, now)] == kept


def test_further_spans_and_redaction(spark, empty):
    rows = [(i, f"note {i} token = \"{hashlib.md5(str(i).encode()).hexdigest()}\" end") for i in range(40)]
    rows += [(100 + i, "version 1234-abcd-longidentifierwithoutmuch plainwordwithoutdigits") for i in range(40)]
    rows += [(500, "mail a@b.co or 10.0.0.1"), (501, None), (501, None), (502, "")]
    frame = data.documents(spark, rows)
    got = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert sum("secret" in got[i] for i in range(40)) == 40
    out = pii.redacted(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[500] == "mail <email> or <ip>" and texts[501] is None and texts[502] == ""
    assert texts[0] == 'note 0 token = "<secret>" end'
    assert pii.personal_data(empty).count() == 0 and pii.redacted(empty).count() == 0


# decontamination

def words_of(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def plain_tiles(item, text, least):
    """Greedy string tiling by looking at every pair of places again for each tile."""
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for x in range(len(item)):
            for y in range(len(text)):
                n = 0
                while (x + n < len(item) and y + n < len(text) and item[x + n] == text[y + n]
                       and free_item[x + n] and free_text[y + n]):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (x, y, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_item[best[0] + k] = free_text[best[1] + k] = False


def test_tiles_are_the_greedy_ones():
    rng = random.Random(10)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randrange(4, 20))]
        text = [rng.choice("abc") for _ in range(rng.randrange(4, 30))]
        hashed = [word_hashes(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, 2 * len(w) - 1]), MARKS)[0] for w in (item, text)]
        seeds = [sequence_hashes(w, 3) for w in hashed]
        pairs = [(x, y) for x in range(len(seeds[0])) for y in range(len(seeds[1])) if seeds[0][x] == seeds[1][y]]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        got = tiling.tiles(*hashed, at[:, 0], at[:, 1], 3) if pairs else []
        assert got == plain_tiles(item, text, 3)


def test_planted_items_are_found_in_any_order(spark, monkeypatch):
    rng = random.Random(11)
    noise = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    items = [(i, " ".join(rng.choice(noise) for _ in range(30))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "of the"), (None, items[0][1]), (3, items[3][1])]
    rows, expected = [(200, None), (201, ""), (202, "of the")], {}
    for i in range(60):
        body = " ".join(rng.choice(noise) for _ in range(200))
        if i < 20:
            parts = items[i][1].split()
            passage = parts[15:] + ["zzz"] + parts[:15] if i % 2 else parts
            body += " " + " ".join(passage).upper() + "! " + body
            expected[i] = i
        rows.append((i, body))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 800):
        monkeypatch.setattr(tiling, "BLOCK_BYTES", block)
        got = {r.doc_id: r for r in tiling.report(data.documents(spark, rows), frame).collect()}
        assert {i: r.item_id for i, r in got.items() if r.contaminated} == expected
        assert got[0].coverage == 1.0 and got[0].n_tiles == 1 and got[1].n_tiles == 2 and got[3].n_items == 2
    kept = tiling.clean(data.documents(spark, rows), frame)
    assert kept.columns == data.documents(spark, []).columns and kept.count() == len(rows) - 20


def test_decontamination_against_plain_tiling(spark, small):
    items = [(r["item_id"], words_of(r["text"])) for r in data.table_rows(small, "benchmark")]
    seeds = defaultdict(set)
    for i, words in items:
        for k in range(len(words) - tiling.TILE + 1):
            seeds[tuple(words[k:k + tiling.TILE])].add(i)
    by_id, expected = dict(items), set()
    for doc, text in data.texts(small):
        words = words_of(text)
        near = Counter(i for k in range(len(words) - tiling.TILE + 1) for i in seeds.get(tuple(words[k:k + tiling.TILE]), ()))
        for i in near:
            item = by_id[i]
            spots = [k for k in range(len(words) - tiling.TILE + 1) if i in seeds.get(tuple(words[k:k + tiling.TILE]), ())]
            part = words[max(0, spots[0] - 5):spots[-1] + 60] if len(words) < 400 else words[max(0, spots[0] - 5):spots[0] + 300]
            if sum(t[2] for t in plain_tiles(item, part, tiling.TILE)) >= tiling.COVERAGE * len(item):
                expected.add(doc)
    got = queries.op9_string_tiling(spark, small).collect()
    assert len(got) == len(data.texts(small))
    assert {r.doc_id for r in got if r.contaminated} == expected and expected


def found_in(items, text):
    """{item: (share, tiles)} of all items that tiles cover in part."""
    index = tiling.index_items(*zip(*items, strict=True))
    sieve = np.ones(1, dtype=bool)
    data_ = np.frombuffer(text.encode(), np.uint8)
    words, _ = word_hashes(data_, np.array([0, len(data_)]), MARKS)
    if len(words) < tiling.TILE:
        return {}
    return {int(index.ids[k]): (share, found) for k, share, found in
            tiling.matches(words, sequence_hashes(words, tiling.TILE), index, sieve, 0.01)}


def test_maximal_matches_give_the_greedy_tiles():
    """Whole texts of few words, so that seeds repeat and matches overlap, with items that share seeds."""
    rng = random.Random(15)
    for alphabet in ("a", "ab", "abc") * 25:
        items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 24)))) for i in range(4)]
        items += [(9, "a " * 70), (10, "a b " * 40)]
        text = " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        if rng.random() < 0.3:
            text += " a" * 90
        expected = {}
        for i, item in items:
            found = plain_tiles(item.split(), text.split(), tiling.TILE)
            if sum(t[2] for t in found) >= 0.01 * len(item.split()) and found:
                expected[i] = (sum(t[2] for t in found) / len(item.split()), found)
        assert found_in(items, text) == expected


def test_repetitive_texts_list_few_matches(monkeypatch):
    """20,000 equal words and an item of 2,000 have 40 million equal seeds, and 22,000 maximal matches."""
    listed, lengths = [], tiling._lengths
    monkeypatch.setattr(tiling, "_lengths", lambda *a: listed.append(len(a[-1])) or lengths(*a))
    got = found_in([(1, "la " * 2000), (2, "la lu " * 1000)], "la " * 20_000)
    assert got == {1: (1.0, [(0, 0, 2000)])} and sum(listed) < 30_000
    got = found_in([(1, "la " * 2000), (2, "la lu li " * 700)], "la lu li " * 6_000)
    assert got == {2: (1.0, [(0, 0, 2100)])} and sum(listed) < 60_000


def test_nothing_to_search(spark, strange, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in tiling.report(strange, none).collect()} == {False}
    assert tiling.report(empty, none).count() == 0


# near-duplicates

def check_near(frame, rows, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())
    lowest = data.components(rows, percent)
    assert got == Counter((i, len(data.shingle_set(t)), c, i == c) for (i, t), c in zip(rows, lowest, strict=True))


def test_near_duplicates(spark, small, strange, empty):
    check_near(queries.op10_minhash(spark, small), data.texts(small), 85)
    check_near(minhash.near_duplicates(strange), data.awkward(), 85)
    assert minhash.near_duplicates(empty).count() == 0


def edited(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * rng.randrange(1, 4)
    return " ".join(words)


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = [(1000 - i, edited(rng, base, rng.randrange(8))) for i in range(300)] + [(i, " ".join(base)) for i in range(2000, 2050)]
    check_near(minhash.near_duplicates(data.documents(spark, rows)), rows, 85)


def test_one_of_each_group_stays(spark):
    rows = data.awkward()
    frame = data.documents(spark, rows)
    kept = minhash.distinct_documents(frame)
    assert kept.columns == frame.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    lowest, expected, taken = data.components(rows, 80), Counter(), set()
    for (i, t), c in sorted(zip(rows, lowest, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if i is None or not data.shingle_set(t):
            expected[(i, t)] += 1
        elif i == c and (c, data.shingle_set(t)) not in taken:
            taken.add((c, data.shingle_set(t)))
            expected[(i, t)] += 1
    assert got == expected


def test_pruning_never_drops_what_reaches_the_threshold():
    rng = np.random.default_rng(13)
    for similarity in (0.85, 0.9, 0.99):
        matches = (rng.random((20_000, 192)) < similarity).cumsum(axis=1)
        assert all((matches[:, n - 1] >= minhash.least_matches(n, 0.85, minhash.MISS, 6)).all() for n in range(32, 193, 32))
    assert minhash.least_matches(192, 0.85, minhash.MISS, 6) > 96


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_all_looks_together_hold_the_miss_probability(percent):
    at_most = lambda n, m: sum(comb(n, k) * Fraction(percent, 100) ** k * Fraction(100 - percent, 100) ** (n - k) for k in range(m + 1))
    width, lost = minhash.BANDS * minhash.ROWS, Fraction(0)
    places = range(minhash.BATCH, width + 1, minhash.BATCH)
    for n in places:
        least = minhash.least_matches(n, percent / 100, minhash.MISS, len(places))
        lost += at_most(n, least - 1)
        assert at_most(n + 1, least - 1) < minhash.MISS / len(places)  # the posterior tail of what goes
        assert at_most(n, least) >= minhash.MISS / len(places)  # and nothing more could go
    assert 0 < lost <= minhash.MISS


def test_components_of_paths_stars_and_copies(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(50, 99)] + [(7, 7), (200, None), (300, 299), (299, 300)]
    frame = spark.createDataFrame([(b, a) if b and b % 2 else (a, b) for a, b in links], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    expected = {i: 0 for i in range(41)} | {x: 50 for x in [*range(50, 99), 100]} | {299: 299, 300: 299}
    assert got == expected
    assert components(frame.limit(0)).count() == 0
