"""Vectors, conversations and the pipeline."""

from collections import defaultdict
import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from check import rows_of, sql_rows
from tests.llm import data

from tracehold.llm import ann, chat, minhash, packing, pii, queries, tiling, toxicity


def true_nearest(vectors, k):
    """Rank lists by brute force over (vec_id, vector) pairs of one size."""
    ids = np.array([i for i, _ in vectors])
    matrix = np.array([v for _, v in vectors], dtype=float)
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            scores = (matrix * np.array(v, dtype=float)).sum(axis=1)
            order = [x for x in np.lexsort((ids, -scores)) if ids[x] != i][:k]
            out[i] = [(int(ids[x]), float(scores[x])) for x in order]
    return out


def by_query(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, expected):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in e}) / max(1, len(e)) for q, e in expected.items()])


def test_recall_on_the_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    vectors = [(r["vec_id"], r["embedding"]) for r in data.table_rows(folder, "embeddings")]
    expected, got = true_nearest(vectors, 20), by_query(queries.op1_hash_prefix_forest(spark, folder))
    assert set(got) == set(expected) and all(len(x) == 20 for x in got.values())
    assert recall(got, expected) >= 0.9
    exact = {(q, i): s for q, e in expected.items() for i, s in e}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, x in got.items() for i, s in x if (q, i) in exact)
    assert all(x == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    index, rows = ann.build_index(frame, block_bytes=40_000)
    assert index.count() > 3
    got = by_query(ann.nearest(index, rows.where("vec_id % 20 = 0"), 20, block_bytes=4000))
    stored = {r.vec_id: r.vector for r in rows.collect()}
    assert recall(got, true_nearest(list(stored.items()), 20)) >= 0.9


def test_the_root_holds_everything(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, np.round(v, 1).tolist()) for i, v in enumerate(rng.standard_normal((200, 4)))]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    index, rows = ann.build_index(frame)
    assert by_query(ann.nearest(index, rows.where("vec_id % 20 = 0"), 20, entries=100.0)) == true_nearest(vectors, 20)


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(i, one) for i in range(60)] + [(60, [0.0] * 3), (80, None), (100, [1.0, None, 2.0]), (120, [1.0, float("nan"), 1.0]),
            (140, [1.0, float("inf"), 1.0]), (160, []), (None, one), (180, [1.0, 1.0]), (200, [2.0, 1.0]), (20, one), (220, [3.0])]
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, size string")
    index, usable = ann.build_index(frame)
    got = by_query(ann.nearest(index, usable.where("vec_id % 20 = 0"), 20))
    assert set(got) == {0, 20, 40, 180, 200}  # 220 has nothing to compare with
    assert got[20] == [(i, 9.0) for i in range(21) if i != 20]
    assert got[180] == [(200, 3.0)] and got[200] == [(180, 3.0)]
    index, usable = ann.build_index(frame.limit(0))
    assert ann.nearest(index, usable).count() == 0


# conversations

@pytest.fixture
def sql():
    return duckdb.connect()


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, start int")


AWKWARD = [
    (1, 0, "system", "be kind"), (1, 1, "anna", "hi"), (1, 2, "bo b", "hé 中"), (1, 3, "anna", None), (1, 3, "anna", None),
    (1, None, "carl", "late"), (1, 200, None, "who"), (2, 0, "system", "alone"), (None, 0, "anna", "lost"), (None, 0, "anna", "lost"),
    (None, 1, "system", "lost too"), (3, -1, "a", ""), (3, 70, "b", "x" * 100_000), (3, 70, "b", "y"), (3, 70, "a", "y"),
]


def test_perspectives_equal_sql(spark, sql):
    frame = turns(spark, AWKWARD)
    sql.register("conversations", frame.toPandas().assign(turn=lambda t: t["turn"].astype("Int64"), conv_id=lambda t: t["conv_id"].astype("Int64")))
    columns, expected = sql_rows(sql, chat.ORACLE)
    got = chat.perspectives(frame)
    assert sorted(got.columns) == columns
    assert rows_of(got) == expected
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_masks_show_the_speakers_own_words(spark, small):
    told = queries.op8_chat_formatting(spark, small)
    whole = {(r.conv_id, r.speaker): r for r in chat.dialogues(told).collect()}
    words = defaultdict(list)
    for r in sorted(data.table_rows(small, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        words[r["conv_id"], r["role"]].append(r["text"])
    for (conversation, speaker), r in whole.items():
        assert [r.text[m.start:m.end] for m in r.masks] == [f"{t}<|im_end|>" for t in words[conversation, speaker]]
        assert r.text.count("<|im_start|>assistant\n") == len(r.masks)
        assert "user name=" + speaker not in r.text
    assert {k for k in words if k[1] != "system"} == set(whole)


def test_order_of_a_long_dialogue(spark):
    rows = [(9, t, "ab"[t % 2], f"turn {t}") for t in range(500)]
    random.Random(3).shuffle(rows)
    got = {r.speaker: r.text for r in chat.dialogues(chat.perspectives(turns(spark, rows))).collect()}
    at = [got["a"].index(f"turn {t}<") for t in range(500)]
    assert at == sorted(at)


# pipeline

def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_pipeline_against_its_parts(spark):
    """Each stage's rows from plain rules over what the stage before kept."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        rows = [tuple(r) for r in out.collect()]
        before = {r[0]: r for r in map(tuple, docs.collect())}
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
            assert {r[0] for r in rows} == {r.doc_id for r in scored if not r.predicted}
        elif name == "near_duplicates":
            pairs = [(i, r[1]) for i, r in before.items()]
            near = shared_components(pairs, 80)
            assert {r[0] for r in rows} == {i for (i, _), c in zip(pairs, near, strict=True) if i == c}
        elif name == "decontamination":
            found = tiling.report(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
            assert {r[0] for r in rows} == {r.doc_id for r in found if not r.contaminated}
        if name == "personal_data":
            assert {r[0] for r in rows} == set(before)
            assert not any(pii.base_spans(r[1]) for r in rows)
        else:
            assert all(before[r[0]] == r for r in rows)
        assert 0.5 * len(before) < len(rows) <= len(before)
        kept[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    packed = packing.pack_documents(docs, queries.tokenizer_path())
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, folder).select(order).collect()) == sorted(packed.select(order).collect())


def shared_components(rows, percent):
    """data.components for more rows: only pairs that share a shingle are compared."""
    sets, where = [data.shingle_set(t) for _, t in rows], defaultdict(list)
    for x, s in enumerate(sets):
        for shingle in s:
            where[shingle].append(x)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in {(a, b) for xs in where.values() for k, a in enumerate(xs) for b in xs[k + 1:]}:
        both = len(sets[x] & sets[y])
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        low[root(x)] = min(low.get(root(x), i), i)
    return [low[root(x)] for x in range(len(rows))]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [r for r in data.awkward() if r[0] != 9]
    docs = data.documents(spark, rows)
    out = stage(spark, docs, small)
    assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
    if name in ("personal_data", "packing"):
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert stage(spark, docs.limit(0), small).count() == 0


def test_minhash_stage_uses_its_own_bands():
    assert (1 - 0.8 ** 5) ** 40 < 1e-6 and (1 - 0.85 ** minhash.ROWS) ** minhash.BANDS < 1e-6
