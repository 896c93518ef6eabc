"""Randomised checks of the small helpers against plain Python."""

import ast
import hashlib
import json
from contextlib import suppress

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracehold.functions.hashing import feature_seed, hex_mod, seeds_of_digests
from tracehold.functions.text import contains_any, strip, strip_fences, two_decimals
from tracehold.functions import fixed_values as fv
from tracehold.sources import json_blocks
from tracehold.sources.json_logs import ObjectCutter

import pandas as pd
import pytest

def objects_of(text):
    """Log objects of a text that comes in pieces, cut at closing braces as the reader does."""
    cutter = ObjectCutter()
    pieces = [("}" if i else "") + piece for i, piece in enumerate(text.split("}"))]
    found = [json.loads(r) for piece in pieces for r in cutter.feed(piece)]
    cutter.close()
    return found


VALUES = st.one_of(st.none(), st.integers(), st.text(max_size=8), st.lists(st.text(max_size=3), max_size=2))
LOGS = st.lists(st.dictionaries(st.text(min_size=1, max_size=5), VALUES, max_size=4), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(LOGS, st.sampled_from(["array", "indented", "lines", "tight", "pretty", "literal"]))
def test_any_layout_gives_the_same_logs(logs, layout):
    if layout == "literal" and not any("'" in repr(x) for x in logs):
        return
    text = {
        "array": lambda: json.dumps(logs),
        "indented": lambda: json.dumps(logs, indent=3),
        "lines": lambda: "\n".join(map(json.dumps, logs)),
        "tight": lambda: "".join(map(json.dumps, logs)),
        "pretty": lambda: "\r\n\t".join(json.dumps(x, indent=1) for x in logs),
        "literal": lambda: repr(logs),
    }[layout]()
    assert objects_of(text) == logs


TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40), min_size=1, max_size=200)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_text_helpers(spark, texts):
    texts = texts + ["```bash\n  x y \n```\n", "\x1c a \x85", "ｓｓｈｄ", "SSHD", "a nc b", "sync"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    t = F.col("t")
    rows = frame.select(
        t, feature_seed(t).alias("seed"), strip(t).alias("s"), strip_fences(t).alias("f"),
        contains_any(t, fv.RISK_WORDS).alias("risk")).collect()
    for r in rows:
        digest = hashlib.sha256((r.t or "unknown").encode()).digest()
        assert r.seed == int.from_bytes(digest, "big") % 100000 == seeds_of_digests(pd.Series([digest]))[0]
        assert r.s == r.t.strip()
        assert r.f == r.t.replace("```bash", "").replace("```", "").strip()
        assert r.risk == any(w in r.t.lower() for w in fv.RISK_WORDS)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=100), st.integers(2, 2**30))
def test_hex_mod(spark, numbers, modulus):
    frame = spark.createDataFrame([(n.hex(),) for n in numbers], "h string").coalesce(1)
    got = [r[0] for r in frame.select(hex_mod(F.col("h"), modulus)).collect()]
    assert got == [int(n.hex(), 16) % modulus for n in numbers]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 1e6), st.integers(0, 10**6).map(lambda n: n / 1000)), min_size=50, max_size=200))
def test_two_decimals(spark, values):
    values += [0.0, 0.855, 0.125, 3.125, 94.44444, 1 / 3, 99.999, 7025.11, 1234567.891]
    frame = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r[0] for r in frame.select(two_decimals(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def cut_whole(text):
    """Objects of a text up to where it is bad."""
    cutter, found = json_blocks.ObjectCutter(), []
    with suppress(ValueError, SyntaxError):
        for record in cutter.feed(text):
            found.append(record)
    return found


def cut_by_blocks(text, places):
    """Objects of a text cut by blocks that begin behind some of its closing braces, and whether it is bad."""
    pieces = text.split("}")[:-1] if text.endswith("}") else text.split("}")
    if not pieces:
        return [], False
    edges = sorted({0, *(p % len(pieces) for p in places)})
    texts = ["}".join(pieces[a:b]) for a, b in zip(edges, [*edges[1:], len(pieces)], strict=True)]
    blocks = []
    for a, t in zip(edges, texts, strict=True):
        quotes, maps = list(json_blocks.QUOTES), [json_blocks.DepthMap() for _ in range(3)]
        for k, m in enumerate(maps):
            found, quotes[k] = json_blocks.brackets(t + "}", quotes[k])
            m.feed(found)
        lists = [m.lists() for m in maps]
        blocks.append({"src_file": "f", "src_block": a, "size": len(text), "bytes": len(t) + 1, "quotes": quotes,
                       "depths": [x[0] for x in lists], "ended": [x[1] for x in lists], "shifts": [m.shift for m in maps]})
    rows, parts = [], {}
    for begin, t in zip(json_blocks.begins(blocks), texts, strict=True):
        for row in json_blocks._cut_block(begin, iter([(t, True)])):
            if row[4] is None:
                rows.append((row[1], row[2]))
            else:
                parts.setdefault((row[4], row[5]), []).append((row[6], row[2], row[1]))
    for (kind, opened), found in parts.items():
        found.sort()
        last = [n for _, _, n in found if n is not None]
        if found[0][0] == opened and last:
            body = "".join(x for _, x, _ in found)
            try:
                if kind == "object":
                    rows.append((last[0], json_blocks.as_json(body)))
                else:
                    json_blocks.check_between(body)
            except (ValueError, SyntaxError):
                rows.append((last[0], None))
    bad = min((n for n, r in rows if r is None), default=None)
    good = sorted((n, r) for n, r in rows if r is not None and (bad is None or n < bad))
    assert [n for n, _ in good] == list(range(len(good)))
    return [r for _, r in good], bad is not None


NESTED = st.recursive(
    st.sampled_from([1, None, True, "a}b", "{", "'", '"', "\\", "}x[", ""]),
    lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "}", "{'"]), x, max_size=3)), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.fixed_dictionaries({"v": NESTED}), st.sampled_from(["x}{", "}}", 5])), max_size=5),
       st.sampled_from(["array", "literal", "pretty"]), st.lists(st.integers(0, 60), max_size=5),
       st.one_of(st.none(), st.tuples(st.integers(0, 200), st.sampled_from(["", "{", "}", "[", '"', "'", "x"]))))
def test_blocks_give_what_the_whole_text_gives(values, layout, places, edit):
    text = {"array": json.dumps, "literal": repr, "pretty": lambda v: "\n".join(json.dumps(x, indent=1) for x in v)}[layout](values)
    if edit and text:
        at = edit[0] % len(text)
        text = text[:at] + edit[1] + text[at + 1:]
    whole, (found, bad) = cut_whole(text), cut_by_blocks(text, places)
    assert found == whole[:len(found)] and (bad or found == whole)
    assert (found, bad) == cut_by_blocks(text, [])


def test_plain_literals_are_not_evaluated(monkeypatch):
    values = [{"a": n, "b": [None, True, -1.5], "c": {"d": "True, {x}"}} for n in range(100)]
    monkeypatch.setattr(json_blocks.ast, "literal_eval", lambda text: pytest.fail(f"evaluated: {text}"))
    assert [json.loads(json_blocks.as_json(repr(v))) for v in values] == values


LITERALS = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=6), st.binary(max_size=2)),
    lambda v: st.one_of(st.lists(v, max_size=3), st.tuples(v), st.dictionaries(st.one_of(st.text(max_size=3), st.integers()), v, max_size=3)))


@settings(max_examples=500, deadline=None)
@given(st.dictionaries(st.text(max_size=4), LITERALS, max_size=4), st.text("'\"\\#T{}[],:1e- \n", max_size=2), st.integers(0, 60))
def test_literals_become_what_they_say(value, more, place):
    text = repr(value)
    text = text[:place] + more + text[place:]
    try:
        json.loads(text)
        expected = text
    except ValueError:
        try:
            expected = json.dumps(ast.literal_eval(text), ensure_ascii=False, default=str)
        except (ValueError, SyntaxError, TypeError) as problem:
            with pytest.raises(type(problem)):
                json_blocks.as_json(text)
            return
    assert json_blocks.as_json(text) == expected
