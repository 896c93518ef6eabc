"""Cutting log objects out of files by blocks, all blocks of a file at once.

What a brace means depends on all text before it: whether a string is open, and how deep objects and
lists are nested. A block of a file therefore tells first, for each of the three states of quotes that it may
begin in, the state it ends in and a map from the depth at its begin to that at its end. The maps of a file
are put together in order, which gives every block its begin; then the blocks are cut independently,
and only an object that lies over an edge is joined from its parts. No text is shuffled but such parts.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracehold.session import materialize

#: Characters that are looked at together.
CHUNK = 1 << 20
#: Blocks whose begins are sent to all tasks (some 100 bytes each); beyond, blocks are dealt to them.
SENT_BLOCKS = 100_000
QUOTES = ("", "\"", "'")
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")

_STRINGS = r"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"
_PLAIN = r"[^{}\[\]\"']++"
#: All up to the next bracket, the next string that is not closed, or the end.
_NEXT = re.compile(rf"(?:{_PLAIN}|{_STRINGS})*+([{{}}\[\]\"']|\Z)", re.DOTALL)
#: What is not a bracket; of a string that is not closed the quote stays.
_OTHER = re.compile(rf"(?:{_PLAIN}|{_STRINGS})++|([\"']).*+\Z", re.DOTALL)
_CLOSING = {"\"": re.compile(r"(?:[^\"\\]++|\\.)*+\"", re.DOTALL), "'": re.compile(r"(?:[^'\\]++|\\.)*+'", re.DOTALL)}
_BETWEEN = re.compile(
    r"(?:[\s,\[\]﻿]|[-+]?[0-9][0-9.eE+-]*|true|false|null|True|False|None"
    r"|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')*", re.DOTALL)

_QUOTED = re.compile(rf"({_STRINGS})", re.DOTALL)
#: What may stand between the strings of a literal that JSON says in the same way, but for the words.
_MARKS = re.compile(r"(?:[\s{}\[\],:']++|-?[0-9][0-9.eE+-]*+|True|False|None)*+")
#: Openings that neither parser minds.
_SHALLOW = 50
_ENCODE = json.JSONEncoder(ensure_ascii=False, default=str).encode


def _literal(text: str) -> object:
    """The value of a Python literal.

    Where only marks, numbers, strings and the three words stand in it, its strings and words are written as those of JSON
    and the JSON parser tells the value, in a small part of the time; whatever it does not take is evaluated as it is.
    """
    plain = "\"" not in text and "\\" not in text
    parts = text.split("'") if plain else _QUOTED.split(text)
    marks = "'".join(parts[::2])
    if _MARKS.fullmatch(marks) and text.count("{") + text.count("[") <= _SHALLOW:
        try:
            if not plain:
                parts[1::2] = [
                    _ENCODE(ast.literal_eval(s)) if "\\" in s or "\"" in s[1:-1] else f'"{s[1:-1]}"' for s in parts[1::2]]
            if "T" in marks or "F" in marks or "N" in marks:
                parts[::2] = [p.replace("True", "true").replace("False", "false").replace("None", "null") for p in parts[::2]]
            return json.loads(("\"" if plain else "").join(parts))
        except (ValueError, SyntaxError):
            pass
    return ast.literal_eval(text)


def as_json(text: str) -> str:
    """An object's own text if it is JSON, else the Python literal that it is, as JSON."""
    if not text.startswith("{'"):  # no JSON begins so
        try:
            json.loads(text)
            return text
        except ValueError:
            pass
    return _ENCODE(_literal(text))


def check_between(text: str) -> None:
    """ValueError if something but marks and plain values stands between objects."""
    if not _BETWEEN.fullmatch(text):
        raise ValueError(f"no log object: {text.strip()[:60]!r}")


class ObjectCutter:
    """Cuts log objects out of a text that comes in pieces, and gives them as JSON.

    Objects are JSON or Python literals; between them white space, commas, brackets and
    plain values may stand. Only an object that is not closed yet is held. A text that begins inside a string
    (``quote``) or an object (``depth``) of the text before has that object's end, or the end of what stands
    between two objects, as its ``head``; the text that is left over at the end is ``rest``.
    """

    def __init__(self, quote: str = "", depth: int = 0) -> None:
        self.held: list[str] = []
        self.depth, self.quote = depth, quote
        self.inside, self.head = bool(quote or depth), None

    def feed(self, text: str) -> Iterator[str]:
        """The objects that end in this piece; ValueError at anything that is no log object."""
        at = place = 0  # what stands before ``at`` is done with, or belongs to the open object
        if self.quote:
            closing = _CLOSING[self.quote].match(text)
            if not closing:
                self.held.append(text)
                return
            self.quote, place = "", closing.end()
        for mark in _NEXT.finditer(text, place):
            sign, here = mark.group(1), mark.end()
            if sign in ("\"", "'"):
                self.quote = sign
                break
            if sign == "{" or (sign == "[" and self.depth):
                if not self.depth:
                    self._between(text[at:here - 1])
                    at = here - 1
                self.depth += 1
            elif sign and sign in "}]" and self.depth:
                self.depth -= 1
                if not self.depth:
                    whole = "".join([*self.held, text[at:here]])
                    self.held, at = [], here
                    if self.inside:
                        self.inside, self.head = False, whole
                    else:
                        yield as_json(whole)
        self.held.append(text[at:])

    @property
    def rest(self) -> str:
        return "".join(self.held)

    def _between(self, text: str) -> None:
        text = "".join([*self.held, text])
        self.held = []
        if self.inside:
            self.inside, self.head = False, text
        else:
            check_between(text)

    def close(self) -> None:
        if self.depth:
            raise ValueError("the file ends inside an object")
        self._between("")


# a block as a map of states

class DepthMap:
    """What brackets outside strings do to any depth: new depths and ended objects.

    Depths up to ``len(self.depths) - 1`` are listed; greater ones change by ``shift`` and no object
    ends. Depths that have become equal stay so and are followed together.
    """

    def __init__(self) -> None:
        self.shift, self.reached = 0, 0  # of depths that are not listed; how many are, but 0
        self.groups = [[0, 0, [(0, 0)]]]  # depth now, objects ended, (depth at begin, ended before it joined)

    def feed(self, brackets: str) -> None:
        groups = self.groups
        for sign in brackets:
            if sign == "{":
                self.shift += 1
                for g in groups:
                    g[0] += 1
                continue
            if sign == "[":
                self.shift += 1
                for g in groups:
                    if g[0]:
                        g[0] += 1
                continue
            self.shift -= 1
            empty = None
            for g in groups:
                if g[0]:
                    g[0] -= 1
                    g[1] += not g[0]
                if not g[0]:
                    if empty is None:
                        empty = g
                    else:  # equal from now on
                        empty[2] += [(d, n + g[1] - empty[1]) for d, n in g[2]]
                        g[0] = -1
            if self.shift < -self.reached:
                self.reached += 1
                if empty is None:
                    groups.append([0, 1, [(self.reached, 0)]])
                else:
                    empty[2].append((self.reached, 1 - empty[1]))
            if len(groups) > 1:
                groups = self.groups = [g for g in groups if g[0] >= 0]

    def lists(self) -> tuple[list[int], list[int]]:
        """New depth and ended objects for each listed depth."""
        depths, ended = [0] * (self.reached + 1), [0] * (self.reached + 1)
        for depth, n, members in self.groups:
            for d, more in members:
                depths[d], ended[d] = depth, n + more
        return depths, ended


def brackets(text: str, quote: str) -> tuple[str, str]:
    """The brackets of a text outside strings, and the quote that is open at its end."""
    if quote:
        closing = _CLOSING[quote].match(text)
        if not closing:
            return "", quote
        text = text[closing.end():]
    found = _OTHER.sub(r"\1", text)
    return (found[:-1], found[-1]) if found and found[-1] in "\"'" else (found, "")


def begins(blocks: list[dict]) -> list[dict]:
    """For the blocks of a file in order: the state that each begins in.

    ``quote``, ``depth``, ``src_row`` (objects ended before), ``open_block`` (where the object or the value begins
    that is open), ``last``, and ``lacks``: the file has no closing brace after its last piece.
    """
    quote, depth, row, opened, out = "", 0, 0, -1, []
    total = sum(b["bytes"] for b in blocks)
    for k, b in enumerate(blocks):
        out.append({"src_file": b["src_file"], "src_block": b["src_block"], "quote": quote, "depth": depth, "src_row": row,
                    "open_block": opened, "last": k == len(blocks) - 1, "lacks": total > b["size"]})
        which = QUOTES.index(quote)
        depths, ended = list(b["depths"][which]), list(b["ended"][which])
        listed = depth < len(depths)
        after, n = (int(depths[depth]), int(ended[depth])) if listed else (depth + int(b["shifts"][which]), 0)
        goes_on = not listed or (quote and not depth and not after and not n)
        if not goes_on:
            opened = b["src_block"]
        quote, depth, row = b["quotes"][which], after, row + n
    return out


_SUMMARY = "src_file string, src_block long, size long, bytes long, quotes array<string>, " \
           "depths array<array<int>>, ended array<array<long>>, shifts array<int>"
_BEGINS = "src_file string, src_block long, quote string, depth int, src_row long, open_block long, last boolean, lacks boolean"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str, int, bool]]:
    """(other columns, text, bytes, whether it is the block's last) of the chunks of blocks of pieces, in order.

    The pieces of a block (src_file, src_block, piece, ...) follow each other. The brace after a block's last
    piece is counted, but not in the text.
    """
    at, row, held, size, begun = None, {}, [], 0, ""

    def text() -> str:
        return begun + b"}".join(held).decode("utf-8", errors="replace")

    for batch in batches:
        files, starts = batch.column(0), batch.column(1)
        for low, high in _stretches(files, starts):
            now = (starts[low].as_py(), files[low].as_py())
            if now != at:
                if at is not None:
                    yield row, text(), size, True
                at, held, size, begun = now, [], 0, ""
                row = {n: batch.column(c)[low].as_py() for c, n in enumerate(batch.schema.names) if c != 2}
            for body in batch.column(2).slice(low, high - low).to_pylist():
                if size > CHUNK:
                    yield row, text(), size, False
                    held, size, begun = [], 0, "}"
                held.append(body)
                size += len(body) + 1
    if at is not None:
        yield row, text(), size, True


def _stretches(files: pa.Array, starts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where the pieces of one block begin and end among the rows of a batch."""
    count = len(files)
    if not count:
        return
    changes = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
    edges = [0, *(pc.indices_nonzero(changes).to_numpy() + 1).tolist(), count]
    yield from zip(edges[:-1], edges[1:], strict=True)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per block of ``pieces`` (src_file, src_block, piece, size, in order): its map of states."""
    schema = pa.schema([
        ("src_file", pa.string()), ("src_block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.list_(pa.string())),
        ("depths", pa.list_(pa.list_(pa.int32()))), ("ended", pa.list_(pa.list_(pa.int64()))), ("shifts", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fresh = [], True
        for block, text, size, final in _chunks(batches):
            if fresh:
                count, quotes, maps = 0, list(QUOTES), [DepthMap() for _ in QUOTES]
            count, fresh = count + size, final
            for k, m in enumerate(maps):
                found, quotes[k] = brackets(text + "}" if final else text, quotes[k])
                m.feed(found)
            if final:
                listed = [m.lists() for m in maps]
                out.append({**block, "bytes": count, "quotes": quotes, "depths": [x[0] for x in listed],
                            "ended": [x[1] for x in listed], "shifts": [m.shift for m in maps]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pieces.select("src_file", "src_block", "piece", "size").mapInArrow(work, _SUMMARY)


def block_begins(found: DataFrame) -> DataFrame:
    """The state that each block begins in, from ``summaries``; the blocks of one file (some 100 bytes each) meet."""
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = begins(frame.sort_values("src_block").to_dict("records"))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _BEGINS.split(", ")])

    return found.groupBy("src_file").applyInPandas(work, _BEGINS)


# cutting

_CUT = "src_file string, src_row long, record string, error string, kind string, open_block long, src_block long"
_CUT_ARROW = pa.schema([("src_file", pa.string()), ("src_row", pa.int64()), ("record", pa.string()), ("error", pa.string()),
                        ("kind", pa.string()), ("open_block", pa.int64()), ("src_block", pa.int64())])
_BAD = (ValueError, SyntaxError, MemoryError, RecursionError)


def _told(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _cut_block(block: dict, chunks: Iterator[tuple[str, bool]]) -> Iterator[tuple]:
    """Rows of ``_CUT``: records, parts of what lies over an edge (``kind``), and at most one error.

    Kinds are ``object`` and ``between``; the row number of a part is set if it is the last one.
    """
    file, here, opened = block["src_file"], block["src_block"], block["open_block"]
    kind = "object" if block["depth"] else "between"
    cutter, row = ObjectCutter(block["quote"], block["depth"]), block["src_row"]

    def head() -> tuple:
        return file, row, cutter.head, None, kind, opened, here

    waits = cutter.inside
    try:
        for text, final in chunks:
            if final and not block["last"]:
                text += "}"
            elif final and not block["lacks"] and not file.lower().endswith(COMPRESSED):
                text += "}"
            for record in cutter.feed(text):
                if waits and cutter.head is not None:
                    yield head()
                    waits, row = False, row + (kind == "object")
                yield file, row, record, None, None, None, here
                row += 1
        if block["last"] and cutter.depth and file.lower().endswith(COMPRESSED):
            for record in cutter.feed("}"):  # whether it stands there cannot be told from the size
                if waits and cutter.head is not None:
                    yield head()
                    waits, row = False, row + (kind == "object")
                yield file, row, record, None, None, None, here
                row += 1
        if waits and cutter.head is not None:
            yield head()
            waits, row = False, row + (kind == "object")
        if block["last"] or not (cutter.depth or cutter.quote):
            if cutter.quote and not cutter.depth:
                raise ValueError("the file ends inside a string")
            cutter.close()
            if waits:
                yield head()
        else:
            yield file, None, cutter.rest, None, "object" if cutter.depth else "between", opened if cutter.inside else here, here
    except _BAD as problem:
        if waits and cutter.head is not None:
            yield head()
            row += kind == "object"
        yield file, row, None, _told(problem), None, None, here


def _cut(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, rows, size = _chunks(batches), [], 0
        for block, text, _, final in chunks:
            if block["quote"] is None:
                raise RuntimeError(f"{block['src_file']} was split otherwise when it was read again")

            def of_block(text=text, final=final):
                yield text, final
                while not final:
                    _, text, _, final = next(chunks)
                    yield text, final

            parts = of_block()
            for row in _cut_block(block, parts):
                rows.append(row)
                size += len(row[2] or "") + 100
                if size > CHUNK:
                    yield _batch(rows)
                    rows, size = [], 0
            for _ in parts:  # the rest of a block behind an error
                pass
        yield _batch(rows)

    return pieces.mapInArrow(run, _CUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_CUT_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _CUT_ARROW, strict=True)], schema=_CUT_ARROW)


def _joined(parts: DataFrame) -> DataFrame:
    """Records and errors of what lies over edges: the parts of one object, or of one stretch between two, in order."""
    whole = parts.groupBy("src_file", "kind", "open_block").agg(
        F.max("src_row").alias("src_row"), F.max("src_block").alias("src_block"), F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("src_block", "record"))), lambda p: p["record"]), "").alias("text"),
        (F.min("src_block") == F.first("open_block")).alias("_begun")).where("_begun AND src_row IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, kind, row, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if kind == "object":
                        rows.append((file, row, as_json(text), None, None, None, block))
                    else:
                        check_between(text)
                except _BAD as problem:
                    rows.append((file, row, None, _told(problem), None, None, block))
            yield _batch(rows)

    return whole.select("src_file", "kind", "src_row", "src_block", "text").mapInArrow(work, _CUT)


def cut_files(pieces: DataFrame, sent_blocks: int = SENT_BLOCKS) -> DataFrame:
    """src_file, src_row, record and error of files cut at closing braces by the text reader.

    ``pieces`` has src_file, src_block, src_row (in order within a block), piece (binary) and size (of the file).
    A file that is bad from some place on gives its records before it and one error. Files without
    text give no rows. The text is read twice (states, then objects); it is dealt anew only where a
    job has more than ``sent_blocks`` blocks. The records are stored.
    """
    found = materialize(summaries(pieces), "block-summaries")
    starts = materialize(block_begins(found), "block-begins")
    if starts.count() <= sent_blocks:
        ready = pieces.join(F.broadcast(starts.withColumnRenamed("src_row", "first_row")), ["src_file", "src_block"], "left")
    else:
        ready = pieces.join(starts.withColumnRenamed("src_row", "first_row"), ["src_file", "src_block"], "left").repartition(
            "src_file", "src_block").sortWithinPartitions("src_file", "src_block", "src_row")
    ready = ready.select("src_file", "src_block", "piece", "quote", "depth", F.col("first_row").alias("src_row"), "open_block", "last", "lacks")
    cut = materialize(_cut(ready), "cut-records")
    parts = cut.where("kind IS NOT NULL")
    rows = cut.where("kind IS NULL")
    if parts.limit(1).count():
        rows = rows.unionByName(materialize(_joined(parts), "joined-records"))
    rows = rows.select("src_file", "src_row", "record", "error")
    errors = rows.where("error IS NOT NULL")
    if not errors.limit(1).count():
        return rows
    first = errors.groupBy("src_file").agg(F.min(F.struct("src_row", "error")).alias("_bad"))
    good = rows.where("error IS NULL").join(first, "src_file", "left").where(
        F.col("_bad").isNull() | (F.col("src_row") < F.col("_bad.src_row"))).drop("_bad")
    return good.unionByName(first.select("src_file", "_bad.src_row", F.lit(None).cast("string").alias("record"), "_bad.error"))
