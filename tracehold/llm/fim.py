"""Fill-in-middle by piece tables: a document is a list of descriptors over buffers that never change.

A descriptor is (buffer, start, length) in bytes: buffer 0 is the document's text, buffer 1 the
sentinels. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels
between them, and the inverse permutation of a cut output restores the text. Bytes are copied
only where an output is asked for; hashes are taken descriptor by descriptor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import slices

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, MARKS = 0, 1
#: The order of prefix (0), middle (1) and suffix (2) in each form, and the sentinel before each.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_MARK = {0: (MARKS, 0, 3), 2: (MARKS, 3, 3), 1: (MARKS, 6, 3)}
_LETTER = np.array([chr(x).isalpha() and x < 128 for x in range(256)])

Piece = tuple[int, int, int]
TABLE = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, " \
        "pieces array<struct<buffer:int,start:int,length:int>>"


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The same bytes with an edge between two descriptors after ``at`` bytes; empty descriptors stand for empty parts."""
    out, left = [], at
    for k, (buffer, start, length) in enumerate(pieces):
        if left <= length:
            return [*out, (buffer, start, left), (buffer, start + left, length - left), *pieces[k + 1:]]
        out.append((buffer, start, length))
        left -= length
    raise ValueError("a cut lies behind the end")


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of a form, each behind its sentinel."""
    return [piece for part in ORDERS[form] for piece in (_MARK[part], parts[part])]


def restore(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output (as buffer 0) that spell the text it was made from.

    The output is cut before and behind its sentinels, the sentinels are left out, and the rest is put
    back by the inverse of the form's permutation. No text that is not plain holds a sentinel, and a
    sentinel's first byte occurs in it only once, so that the first one found is the one put in.
    """
    pieces = [(TEXT, 0, len(output))]
    if form == "plain":
        return pieces
    at = 0
    for part in ORDERS[form]:
        _, start, length = _MARK[part]
        at = output.index(SENTINELS[start:start + length], at)
        pieces = split(split(pieces, at), at + length)
        at += length
    parts = pieces[2::2]
    inverse = np.argsort(ORDERS[form])
    return [parts[k] for k in inverse]


def stream(pieces: list[Piece], text: memoryview) -> Iterator[memoryview]:
    """The bytes of some descriptors, without copies."""
    buffers = (text, memoryview(SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def sha256(pieces: list[Piece], text: memoryview) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces, text):
        digest.update(part)
    return digest.hexdigest()


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document's name and the seed; a row without a name has the empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4))


def _rows(ids: list, data: np.ndarray, offsets: np.ndarray, seed: int, percent: int, suffix_first: int):
    """One row of ``TABLE`` without doc_id and text for each text of a step."""
    letter, point = _LETTER[data], (data & 0xC0) != 0x80
    begins = point.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True  # no token crosses documents
    tokens = np.flatnonzero(begins)
    first = np.searchsorted(tokens, offsets)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(point, out=points[1:])
    whole = data.tobytes()
    for row, doc_id in enumerate(ids):
        a, b = int(offsets[row]), int(offsets[row + 1])
        n = int(first[row + 1] - first[row])
        h1, h2, h3, h4 = draws(doc_id, seed)
        plain = a == b or h3 % 100 >= percent or any(whole.find(s, a, b) >= 0 for s in (PREFIX, SUFFIX, MIDDLE))
        pieces: list[Piece] = [(TEXT, 0, b - a)]
        if plain:
            yield n, "plain", None, None, pieces
            continue
        ends = [int(tokens[first[row] + k]) if k < n else b for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
        for end in ends:
            pieces = split(pieces, end - a)
        form = "spm" if h4 % 100 < suffix_first else "psm"
        yield (n, form, int(points[ends[0]] - points[a]), int(points[ends[1]] - points[ends[0]]), arrange(pieces, form))


def piece_tables(documents: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, text, n (tokens), form, prefix_chars, middle_chars and pieces of every document.

    A token is a run of ASCII letters or any other code point. Two cuts at token edges are drawn
    from the document's name. Of 100 documents ``percent`` are rearranged, of these ``suffix_first`` with the
    suffix first (``spm``), the others prefix, suffix, middle (``psm``). Null and empty texts, and
    texts that hold a sentinel, are ``plain``, with null character counts. Rows that repeat a doc_id
    have the same draws. Rows without a doc_id draw from the empty name. Columns other than doc_id and text are
    not looked at. A text is cut whole, however long; no rows give none.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("form", pa.string()),
            ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
            ("pieces", pa.list_(pa.struct([(x, pa.int32()) for x in ("buffer", "start", "length")])))])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in slices(batch.column(1)):
                columns = list(zip(*_rows(ids[i:j], data, offsets, seed, percent, suffix_first), strict=True))
                pieces = pa.array([[dict(zip(("buffer", "start", "length"), p, strict=True)) for p in x] for x in columns[4]],
                                  type=schema.field("pieces").type)
                rest = [pa.array(c, type=schema.field(k + 2).type) for k, c in enumerate(columns[:4])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j].cast(pa.string()), *rest, pieces], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(work, TABLE)


def _each(tables: DataFrame, made, schema: str) -> DataFrame:
    """One row per document: its doc_id and what ``made`` gives for (text, form, pieces)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = memoryview(row["text"].encode())
                rows.append(made(row, text, [(p["buffer"], p["start"], p["length"]) for p in row["pieces"]]))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names)

    return tables.mapInArrow(work, schema)


def outputs(tables: DataFrame) -> DataFrame:
    """doc_id, form and output text of every piece table."""
    return _each(tables, lambda row, text, pieces: (
        row["doc_id"], row["form"], b"".join(stream(pieces, text)).decode()), "doc_id long, form string, output string")


def restored(rendered: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``outputs``, from its output and form alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = output.encode()
                texts.append(b"".join(stream(restore(body, form), memoryview(body))).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return rendered.select("doc_id", "form", "output").mapInArrow(work, "doc_id long, text string")


def digests(tables: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of each output and of the text restored from it."""
    def made(row, text, pieces):
        output = b"".join(stream(pieces, text))
        return (row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], sha256(pieces, text),
                sha256(restore(output, row["form"]), memoryview(output)))

    return _each(tables, made, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                               "output_sha256 string, restored_sha256 string")


#: The query in DuckDB: tokens as a list, cut, put in order, and put back by the places of the sentinels.
ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tokens,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
    greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT doc_id, n, form, t, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m,
    array_to_string(tokens[b + 1:], '') AS s FROM cuts
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN split_part(substr(split_part(o, '<S>', 1), 4), '<M>', 1) || split_part(o, '<M>', 2)
                    || split_part(split_part(o, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2)
                    || substr(split_part(o, '<P>', 1), 4) END) AS restored_sha256
FROM made
"""
