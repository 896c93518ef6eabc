"""Token ids of whole texts, with a memory of the words that came before.

White space is dropped by tokenizers whose words end in a suffix, and no token crosses it, so
the ids of a text are those of its pieces between blanks, one after another. A worker encodes a
piece once, with the library; whole batches of texts are then put together from those ids by
array operations. Letter case of ASCII does not matter to such a tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tracehold.llm.common import slices, span_hashes

#: Pieces that a worker remembers; it forgets all of them beyond that.
KEPT_PIECES = 2_000_000
#: Words that the library gets in one string.
JOINED = 256
#: Pieces whose words, digits and marks are plain to see: Latin-1 without blanks and apostrophes.
_PLAIN = re.compile("[!-&(-~\xa1-\xff]+")
_PARTS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[10, 32]] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[44, 46]] = True
_ALNUM = np.array([x < 128 and chr(x).isalnum() for x in range(256)])
#: Second bytes of Latin-1 letters after 0xC3.
_LETTER = np.array([0x80 <= x <= 0xBF and x not in (0x97, 0xB7) for x in range(256)])


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's definition, sent to the executors once (a few MB for any input)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the pieces of some texts.

    Pieces stand between blanks and line feeds; a full stop or comma after a letter or digit and
    before a blank is a piece of its own.
    """
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~_BLANK[data]
    stop = ~inside
    stop[:-1] |= edge[1:n]
    follows = np.append(~inside[1:], True) | edge[1:]  # a blank or the end comes next
    before = np.zeros(n, dtype=bool)
    before[1:] = _ALNUM[data[:-1]] & ~edge[1:n]
    before[2:] |= (data[:-2] == 0xC3) & _LETTER[data[1:-1]] & ~edge[1:n - 1] & ~edge[2:n]
    closed = _CLOSING[data] & follows & before
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n] | closed[1:]
    ends = inside & follows
    ends[:-1] |= closed[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.by_piece = bool(suffix)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(0, dtype=np.uint64)  # sorted hashes of known pieces
        self.places = np.zeros(0, dtype=np.int64)  # where their ids begin
        self.counts = np.zeros(0, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype="<i4"), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<i4") for x in found]

    def _words(self, words: list[str]) -> dict[str, np.ndarray]:
        """Words of letters alone, many in one call, cut where a token ends a word."""
        out: dict[str, np.ndarray] = {}
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups]), strict=True):
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group) and last[-1] == len(ids):
                out.update(zip(group, np.split(ids, last[:-1]), strict=True))
            else:  # a word that is several pieces to the library
                out.update(zip(group, self._whole(group), strict=True))
        return out

    def _learn(self, names: np.ndarray, new: list[str]) -> None:
        """Keep pieces (lower-case in ASCII) under their hashes, given in ascending order."""
        words, made, others = [], {}, []
        for piece in new:
            if piece.isalpha():
                words.append(piece)
            elif _PLAIN.fullmatch(piece):
                made[piece] = _PARTS.findall(piece.lower())
            else:
                others.append(piece)
        parts = set().union(*made.values()) if made else set()
        words += [x for x in parts if x.isalpha()]
        others += [x for x in parts if not x.isalpha()]
        known = self._words(words) if words else {}
        if others:
            known.update(zip(others, self._whole(others), strict=True))
        for piece, some in made.items():
            known[piece] = np.concatenate([known[x] for x in some])
        ids = [known[x] for x in new]
        counts = np.array([len(x) for x in ids], dtype=np.int32)
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids[:self.used], np.zeros(self.used + len(flat) + (1 << 16), dtype="<i4"))
        self.ids[self.used:self.used + len(flat)] = flat
        at = np.searchsorted(self.names, names)
        self.places = np.insert(self.places, at, self.used + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.names = np.insert(self.names, at, names)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts' UTF-8 bytes, one after another, and how many each text has."""
        rows = len(offsets) - 1
        body = data.tobytes()
        if not self.by_piece or any(x in body for x in self.special):
            ids = self._whole([body[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate([*ids, np.zeros(0, dtype="<i4")]), np.array([len(x) for x in ids], dtype=np.int64)
        if len(data) < 3:
            data = np.append(data, np.full(3, 32, dtype=np.uint8))
        first, last = pieces(data, offsets)
        if not len(first):
            return np.zeros(0, dtype="<i4"), np.zeros(rows, dtype=np.int64)
        names, example, which = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True)
        if len(self.names) + len(names) > KEPT_PIECES:
            self._forget()
        at = np.searchsorted(self.names, names)
        unknown = np.ones(len(names), dtype=bool)
        inner = at < len(self.names)
        unknown[inner] = self.names[at[inner]] != names[inner]
        if unknown.any():
            body = body.lower()  # of bytes: A-Z alone
            some = example[unknown]
            self._learn(names[unknown], [body[a:b].decode() for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)])
            at = np.searchsorted(self.names, names)
        at = at[which]
        counts = self.counts[at].astype(np.int64)
        done = np.append(0, np.cumsum(counts))
        ids = self.ids[np.repeat(self.places[at] - done[:-1], counts) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(first, offsets)])

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids per row) of a column of strings, step by step; nulls are empty."""
        for i, j, data, offsets in slices(column):
            yield i, j, *self.encode(data, offsets)


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a definition; it lives as long as the worker."""
    name = hashlib.sha1(definition.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(definition)
    return _encoders[name]


def closed(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text, and where each text begins (one more at the end)."""
    ends = np.cumsum(counts)
    starts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts + 1, out=starts[1:])
    return np.insert(ids, ends, end_id).astype("<i4"), starts


def id_lists(ids: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Ids as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
