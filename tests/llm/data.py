"""A small table of awkward documents, and plain-Python versions of what operators compute."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq

COLUMNS = "doc_id long, text string, lang string, score double, candidates string, n_items string, part string, id string"


def documents(spark, rows):
    """Rows (doc_id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.9, "x", "y", "z", "w") for i, t in rows], COLUMNS)


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, other alphabets."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(None, None), (None, "lonely text"), (None, "lonely text"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (4, "b"),
            (5, passage), (6, passage), (7, passage + " end"), (8, "start " + passage + "."), (9, long), (10, "x" * 300_000),
            (11, "der " * 2000), (12, "A, b. <|endoftext|> it's +1 (650) 555-0199 or a@b.co\x00"), (13, "\x0b\x0c\x1c\x85\xa0"),
            (14, passage.upper()), (15, passage[::-1])]
    return rows


def table_rows(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def texts(folder):
    return [(r["doc_id"], r["text"]) for r in table_rows(folder, "documents")]


def shingle_set(text):
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def components(rows, percent):
    """Smallest doc_id reachable for each row (doc_id, text); None for rows without a doc_id."""
    sets = [shingle_set(t) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return [low.get(root(x)) if i is not None else None for x, (i, _) in enumerate(rows)]
