"""Window dedup, the conversation trie and fill-in-middle, against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from check import rows_of, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import data

from tracehold.llm import fim, queries, trie, windows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_window_dedup", "op12_conversation_trie", "op13_fill_in_middle"])
def test_query_matches_sql_at_both_scales(spark, name):
    for scale in ("sf0.001", "sf0.01"):
        folder, connection = f"/root/testdata/{scale}", duckdb.connect()
        for table in ("documents", "conversations"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        assert rows_of(queries.QUERIES[name](spark, folder)) == sql_rows(connection, queries.ORACLES[name])[1]


# windows

def plain_removals(rows, k):
    """(doc_id, n_words, n_removed, sha of kept words, kept words) for each row (doc_id, text)."""
    lists = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in lists:
        for p in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[p:p + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[p:p + k])] < i:
                gone[p:p + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept), kept))
    return out


def shared_passages(seed, k):
    """Texts with common passages of about k words, copies under several ids and repeats within a text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klm")
    passages = [[word() for _ in range(k + rng.randrange(-2, 12))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 20))]
        rows.append((rng.randrange(45), rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(rng.randrange(60), t) for _, t in rows[:15]] + [(None, rows[3][1]), (7, None), (8, "")]


@pytest.mark.parametrize("seed,k", [(1, 8), (2, 3), (3, 1), (4, 2)])
def test_windows_by_brute_force(spark, seed, k):
    rows = shared_passages(seed, k)
    frame = data.documents(spark, rows)
    removed = windows.removals(frame, window=k)
    expected = plain_removals(rows, k)
    got = windows.digests(removed).collect()
    assert Counter(map(tuple, got)) == Counter(x[:4] for x in expected)
    texts = windows.kept_texts(frame, removed).collect()
    assert Counter((r.doc_id, " ".join(r.text.split())) for r in texts) == Counter((x[0], x[4]) for x in expected)


def test_windows_of_awkward_documents(spark):
    rows = data.awkward()
    got = windows.digests(windows.removals(data.documents(spark, rows))).collect()
    assert Counter(map(tuple, got)) == Counter(x[:4] for x in plain_removals(rows, 50))
    assert windows.removals(data.documents(spark, []), 50).count() == 0


def test_many_equal_rows_have_equal_results(spark):
    text = " ".join(f"w{i % 90}" for i in range(200))
    rows = [(5, text)] * 300 + [(6, text)] * 300 + [(4, "w0 " + text)]
    got = Counter((r.doc_id, r.n_removed) for r in windows.digests(windows.removals(data.documents(spark, rows))).collect())
    assert got == {(4, 0): 1, (5, 200): 300, (6, 200): 300}


def test_spans_are_maximal():
    assert windows.intervals(np.array([7, 3, 12, 40]), 5) == [(3, 17), (40, 45)]
    assert windows.intervals(np.array([], dtype=int), 5) == []


def test_smallest_of_each_run():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 30, 100):
        values = rng.integers(0, 1 << 60, n).astype(np.uint64)
        for w in (1, 2, 3, 7, 26, 30, 64):
            assert windows._smallest(values, w).tolist() == [min(values[i:i + w]) for i in range(max(0, n - w + 1))]


# the trie

def plain_nodes(rows, group=20):
    """The trie's rows by dictionaries, from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, words = defaultdict(list), {(): 0}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (own.get(c - (c % group if c >= 0 else -(-c % group)), [])[:h]) + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path) == d))
    for p in members:
        words[p] = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out.append((
            min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(m),
            sum(len(q) == len(p) + 1 for q in below), sum(not any(len(x) == len(q) + 1 and x[:-1] == q for x in below) for q in below),
            sum((len(members[q]) - 1) * words[q] for q in below), sha(",".join(map(str, sorted(c for c, e in m if e))))))
    return Counter(out)


FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-30, 60), 10_000, 10_001, 20_000]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b c", "", None, "中 é"])))
    rng.shuffle(rows)
    return [*rows, (None, 1, "user", "nobody"), (3, 2, "user", "again"), (3, 2, "user", "again")]


@pytest.mark.parametrize("seed,shard_turns", [(1, 1 << 19), (1, 1), (2, 7), (3, 40)])
def test_trie_by_brute_force(spark, seed, shard_turns):
    rows = dialogues(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = trie.conversation_trie(frame, shard_turns).collect()
    assert Counter(tuple(r[f] for f in FIELDS) for r in got) == plain_nodes(rows)


def test_one_long_and_many_equal_conversations(spark):
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(3000)] + [(c, t, "user", "same") for c in range(100, 5100) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(frame, 500).collect()}
    assert got[5, 0].n_convs == 5001 and got[5, 0].parent_conv_id is None
    ends = [r for r in got.values() if r.conv_id == 100]
    assert [r.n_convs for r in sorted(ends, key=lambda r: r.depth)] == [5000, 5000]
    assert max(ends, key=lambda r: r.depth).ends_sha256 == sha(",".join(map(str, range(100, 5100))))
    assert max(r.depth for r in got.values()) == 3000 - zlib.crc32(b"5") % 4
    assert trie.conversation_trie(frame.limit(0)).count() == 0


def test_ends_of_sparse_numbers_in_order(spark):
    ids = [-9000, -4097, -4096, -1, 4095, 4096, 1 << 40]
    frame = spark.createDataFrame([(c, b"x" * 32) for c in ids], "conv_id long, path_key binary")
    assert [r.ends_sha256 for r in trie._ends(frame).collect()] == [sha(",".join(map(str, ids)))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=600))
def test_findclose_matches_a_stack(choices):
    steps, depth = [1], 1
    for c in choices:
        if c or depth == 1:
            steps.append(1)
            depth += 1
        else:
            steps.append(-1)
            depth -= 1
    steps, stack, expected = np.array(steps + [-1] * depth), [], {}
    for i, x in enumerate(steps):
        if x > 0:
            stack.append(i)
        else:
            expected[stack.pop()] = i
    opens = np.flatnonzero(steps > 0)
    assert trie.Excess(steps).findclose(opens).tolist() == [expected[i] for i in opens.tolist()]


# fill-in-middle

def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_awkward_documents(spark):
    rows = data.awkward() + [(i, t) for i, t in enumerate(["<", "a<P", "<P>x", "x<S>", "<M", ">", "<<S", "P>S>", "\x00\n", "é中😀 a1b2"] * 6, 100)]
    tables = fim.piece_tables(data.documents(spark, rows)).cache()
    expected = [plain_fim(*r) for r in rows]
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    got = Counter(map(tuple, fim.digests(tables).collect()))
    assert got == Counter((*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, rows, strict=True))
    rendered = fim.outputs(tables)
    assert Counter((r.doc_id, r.output) for r in rendered.collect()) == Counter((e[0], e[5]) for e in expected)
    assert Counter(map(tuple, fim.restored(rendered).collect())) == Counter((i, t or "") for i, t in rows)
    tables.unpersist()
    assert fim.piece_tables(data.documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMab é中", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_any_cut_is_restored(text, x, y, form):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    body = text.encode()
    pieces = [(fim.TEXT, 0, len(body))]
    for at in sorted((min(x, len(body)), min(y, len(body)))):
        pieces = fim.split(pieces, at)
    output = b"".join(fim.stream(fim.arrange(pieces, form), memoryview(body)))
    assert b"".join(fim.stream(fim.restore(output, form), memoryview(output))) == body


def test_split_keeps_the_bytes():
    assert fim.split([(0, 0, 5)], 5) == [(0, 0, 5), (0, 5, 0)]
    assert fim.split([(0, 0, 2), (0, 2, 3)], 4) == [(0, 0, 2), (0, 2, 2), (0, 4, 1)]
    with pytest.raises(ValueError):
        fim.split([(0, 0, 2)], 3)
